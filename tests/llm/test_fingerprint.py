import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from forkscope.llm import common, fingerprint


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(longs):
    seed = 42
    for x in longs:
        seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed)
    return signed(seed)


def sketch(text, k=fingerprint.K):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    grams = {chain(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {chain(words)} if words else set()
    return sorted(grams)[:k]


def like(a, b, k=fingerprint.K):
    low = sorted({*a, *b})[:k]
    return sum(x in a and x in b for x in low) / len(low) if low else 1.0


def hexed(s):
    return "".join(f"{x & (2**64 - 1):016x}" for x in s)


def brute(rows):
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    out = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        t, nxt = t or "", nxt or ""
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        a, b, c = sketch(t), sketch(e), sketch(nxt)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), hexed(a), hexed(b), like(a, b), like(a, c)))
    return out


def got(spark, rows, monkeypatch=None, size=3):
    if monkeypatch:
        monkeypatch.setattr(fingerprint, "BLOCK_ROWS", size)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, sketch string, next_text string")
    return sorted(tuple(r) for r in fingerprint.fingerprints(df).collect())


def test_against_brute_force(spark, monkeypatch):
    rows = [(9 * i * i - 40, " ".join(f"W{(i * j) % 7}é" for j in range(i * 3))) for i in range(20)]
    rows += [(10_000, None), (10_001, ""), (10_003, "   "), (10_002, "one"), (20_000, "漢字😀 " * 3000), (None, "no id"), (20_001, "a b c d e"), (20_005, "a b c d e")]
    assert got(spark, rows, monkeypatch) == sorted(brute(rows))
    assert got(spark, rows, monkeypatch, 1000) == sorted(brute(rows))


def test_few_rows(spark):
    assert got(spark, []) == []
    assert got(spark, [(5, "a b c d e f g h")]) == brute([(5, "a b c d e f g h")])
    twice = got(spark, [(5, "a b c"), (5, "a b c"), (6, "d")])
    assert [r[0] for r in twice] == [5, 5, 6]


def test_query(spark):
    rows = [tuple(r) for r in common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in fingerprint.op5_fingerprints(spark, "/root/testdata/sf0.001").collect()) == sorted(brute(rows))


def test_merge_and_estimates(spark):
    texts = [(i % 2, " ".join(f"t{(i // 2) * 300 + j}" for j in range(400))) for i in range(20)] + [(2, None)]
    df = fingerprint.with_sketch(spark.createDataFrame(texts, "key int, text string"), "text", "s")
    merged = {r.key: r.s for r in fingerprint.merged(df, "key", "s").collect()}
    for key in (0, 1):
        every = {h for k, t in texts if k == key for h in sketch(t, 10**9)}
        assert merged[key] == sorted(every)[: fingerprint.K]
    assert merged[2] == []
    row = spark.createDataFrame([(merged[0], sketch(texts[0][1]), [])], "a array<long>, b array<long>, c array<long>").select(
        fingerprint.distinct_shingles(F.col("a")), fingerprint.containment(F.col("b"), F.col("a")), fingerprint.resemblance(F.col("c"), F.col("c")), fingerprint.resemblance(F.col("a"), F.col("c")), fingerprint.containment(F.col("c"), F.col("a"))
    ).first()
    assert row[0] == pytest.approx(10 * 300 + 96, rel=0.3) and row[1] == pytest.approx(1.0, abs=0.4) and row[2:] == (1.0, 0.0, 1.0)


def test_native(spark):
    plan = fingerprint.op5_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
