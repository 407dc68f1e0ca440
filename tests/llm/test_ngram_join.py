import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from forkscope.llm import common, components, ngram_join, shingles


def grams(text, size=4):
    table = {c: c + 32 for c in range(65, 91)}
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(table)) if w]
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} if ws else set()


def components_by_pairs(sets, percent):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(sets))]


def brute(rows):
    rows = [r for r in rows if r[0] is not None]
    sets = [grams(t) for _, t in rows]
    roots = components_by_pairs(sets, 85)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(least.get(r, i), i)
    return sorted((i, len(s), least[r]) for (i, _), s, r in zip(rows, sets, roots))


@given(st.lists(st.text(st.sampled_from("aAbZ \n\té漢😀\x1f\x85"), max_size=40), max_size=6), st.integers(1, 5))
def test_shingles_like_tuples(texts, size):
    hashes, many = shingles.shingles([t.encode() for t in texts], size)
    seen, at = {}, 0
    for t, m in zip(texts, many):
        own = {seen.setdefault(int(h), len(seen)) for h in hashes[at : at + m]}
        at += m
        assert len(own) == len(grams(t, size))
    names = {}
    at = 0
    for t, m in zip(texts, many):
        for g, h in zip(_in_order(t, size), hashes[at : at + m]):
            assert names.setdefault(g, int(h)) == int(h)
        at += m
    assert len(set(names.values())) == len(names)


def _in_order(text, size):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
    return [tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)] if len(ws) >= size else [tuple(ws)] if ws else []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 40), st.sampled_from([20, 50, 85]), st.sampled_from([60, 1200, 5000]))
def test_marks_lose_no_link(seed, n, percent, size):
    rng = random.Random(seed)
    base = rng.sample(range(10**9), size)
    sets = [{x if rng.random() < 0.95 else rng.randrange(10**9) for x in rng.sample(base, rng.randint(size // 5, size))} if rng.random() < 0.7 else {rng.randrange(10**9) for _ in range(60)} for _ in range(n)]
    marks = [ngram_join._marks(shingles.mixed(np.array(sorted(s), np.uint64))) for s in sets]
    pairs = ngram_join.near(np.array([len(s) for s in sets]), marks, percent)
    assert len(pairs) < n
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        parent[find(i)] = find(j)
    # Those near a leader are known to be connected and are not compared among themselves.
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (range(n), [len(s) for s in sets], marks, [0] * n, [len(sets[0])] * n, [marks[0]] * n)], ["doc_id", "n", "marks", "leader", "n_l", "marks_l"])
    known = next(ngram_join._near_leader(percent)([rows])).column("known").to_numpy(zero_copy_only=False)
    assert known[0]
    few = ngram_join.near(np.array([len(s) for s in sets]), marks, percent, known)
    assert len(few) <= n - known.sum()
    led = list(range(n))

    def top(i):
        while led[i] != i:
            i = led[i]
        return i

    for i, j in [*few, *((0, int(k)) for k in np.flatnonzero(known))]:
        led[top(i)] = top(j)
    for i, a in enumerate(sets):
        for j in range(i):
            assert (find(i) == find(j)) <= (top(i) == top(j))
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                assert find(i) == find(j)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 40), st.sampled_from([50, 70, 85, 100]))
def test_prefix_tree_against_all_pairs(seed, n, percent):
    rng = random.Random(seed)
    bases = [rng.sample(range(300), rng.randint(1, 40)) for _ in range(3)]
    sets = []
    for _ in range(n):
        s = set(rng.choice(bases))
        for _ in range(rng.randint(0, 6)):
            s.discard(rng.choice(sorted(s))) if len(s) > 1 and rng.random() < 0.5 else s.add(rng.randrange(400))
        sets.append(s)
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    want = components_by_pairs(sets, percent)
    assert ngram_join.joined(arrays, percent) == want
    leader = rng.randrange(n)
    known = np.array([100 * len(s & sets[leader]) >= percent * len(s | sets[leader]) for s in sets])
    assert ngram_join.joined(arrays, percent, known) == want


def rows_of(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    common_line = [f"c{i}" for i in range(30)]
    bases = [[rng.choice(words) for _ in range(rng.randint(3, 120))] for _ in range(8)]
    rows = []
    for i in range(n):
        ws = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(len(ws))] = rng.choice(words)
        rows.append((3 * i + 1, " ".join([*(common_line if rng.random() < 0.4 else []), *ws])))
    return rows


@pytest.mark.parametrize(("group", "least"), [(ngram_join.GROUP_SHINGLES, 4), (3000, 2)])
def test_against_all_pairs(spark, monkeypatch, group, least):
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", group)
    monkeypatch.setattr(ngram_join, "LOCAL_LEAST", least)
    monkeypatch.setattr(ngram_join, "BUCKET_ROWS", 4096 if least == 4 else 6)
    monkeypatch.setattr(ngram_join, "LED_ROWS", 256 if least == 4 else 3)
    monkeypatch.setattr(ngram_join, "TALLIED", 1 << 21 if least == 4 else 50)
    rows = rows_of(1, 150) + [(0, None), (2, ""), (5, " \n "), (8, "one"), (11, "ONE"), (14, "a b c"), (17, "A b C"), (20, "x " * 4000), (23, "x " * 3000), (None, "one"), (8, "one"), (1, rows_of(1, 2)[1][1])]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n int, gram string")
    assert sorted(tuple(r) for r in ngram_join.components_of(df).collect()) == brute(rows)


def test_rows_of_a_very_large_bucket_that_are_moved(spark):
    """Ten times what is compared at once, five of which are not near the leader: each row moves once or twice, and the five meet all."""
    most = 100
    rows = [(7, i, i % 200 != 3) for i in range(10 * most)] + [(8, i, True) for i in range(10 * most)]
    df = spark.createDataFrame(rows, "gram long, doc_id long, known boolean")
    cells = ngram_join._led_cells(df, "gram", F.lit(1), most).collect()
    assert {r.gram for r in cells} == {7} and len(cells) < 1.2 * 10 * most
    met = {}
    for r in cells:
        met.setdefault((r.i, r.j), []).append(r)
    assert max(len(c) for c in met.values()) < 1.5 * most
    together = {(a.doc_id, b.doc_id) for c in met.values() for a in c if not a.known for b in c}
    assert all((i, j) in together for i in range(3, 1000, 200) for j in range(1000))
    # With many others the known ones meet every block of them, and all pairs of others meet.
    df = spark.createDataFrame([(7, i, i % 2 == 0) for i in range(600)], "gram long, doc_id long, known boolean")
    met = {}
    for r in ngram_join._led_cells(df, "gram", F.lit(1), most).collect():
        met.setdefault((r.i, r.j), []).append(r)
    together = {(a.doc_id, b.doc_id) for c in met.values() for a in c if not a.known for b in c}
    assert all((i, j) in together for i in range(1, 600, 2) for j in range(600))


def test_none(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.components_of(df).collect() == []
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.components_of(df).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_connected(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent) if find(x) != x}


def test_query(spark):
    rows = [tuple(r) for r in common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in ngram_join.op2_ngram_join(spark, "/root/testdata/sf0.001").collect()) == brute(rows)
