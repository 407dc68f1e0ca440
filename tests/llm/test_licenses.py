import itertools
import random

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from forkscope.llm import common, licenses


@given(st.lists(st.integers(0, 20), max_size=9, unique=True))
def test_longest_rising_sequence(values):
    got = [values[i] for i in licenses._rising(values)]
    assert got == sorted(got)
    assert len(got) == max(n for n in range(len(values) + 1) if any(list(c) == sorted(c) for c in itertools.combinations(values, n)))


@settings(max_examples=200)
@given(st.lists(st.sampled_from("abcdefghij"), max_size=14), st.lists(st.sampled_from("abcdefghij"), max_size=14))
def test_aligned_words_are_equal_and_in_order(a, b):
    pairs = licenses.aligned(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    if a == b:
        assert len(pairs) == len(a)


def test_every_template_is_found_in_long_texts():
    rng, scanner = random.Random(1), licenses.Scanner()
    filler = "the of and software word other license copy under this lorem ipsum".split()
    assert {"MIT", "Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "BSD-3-Clause"} <= set(licenses.templates())
    for name, text in licenses.templates().items():
        before = [rng.choice(filler) for _ in range(3000)]
        found = {x[0]: x for x in scanner.scan(" ".join([*before, text, *before[:500]]))}
        n = len(licenses.words(text))
        assert found[name][1] == 1.0 and found[name][3] == 2999 + n
        assert 0 <= 3000 - found[name][2] <= max(1, n // 16)  # its first word may come once more just before


def test_edited_templates():
    scanner, rng = licenses.Scanner(), random.Random(2)
    for name in ("MIT", "GPL-2"):
        t = licenses.words(licenses.templates()[name])
        for lost, there in ((0.1, True), (0.5, False)):
            own = [w if rng.random() > lost else "x" for w in t]
            found = {x[0]: x[1] for x in scanner.scan("intro " + " ".join(own) + " end")}
            assert (name in found) == there
            if there:
                assert sum(w != "x" for w in own) / len(t) >= found[name] > 0.85
    assert scanner.scan("Released under\nthe  MIT -- license!") == [("MIT-notice", 1.0, 0, 4)]
    twice = "Released under the MIT License. " * 3
    assert scanner.scan(twice)[0][:2] == ("MIT-notice", 1.0)
    assert scanner.scan("the license under which this is released, not known") == []


def test_insertions_of_any_length():
    scanner = licenses.Scanner()
    for name, text in licenses.templates().items():
        t, more = licenses.words(text), [f"w{i}" for i in range(500)]
        for n in (64, 500):
            middle = t[: len(t) // 2] + more[:n] + t[len(t) // 2 :]
            found = {x[0]: x[1:] for x in scanner.scan(" ".join([*more, *middle, *more]))}
            assert found[name][0] == 1.0 and found[name][2] == 500 + len(middle) - 1
        if len(t) >= licenses.SHORT:
            turns = [w for word in t for w in (word, "x")]
            assert {x[0]: x[1] for x in scanner.scan(" ".join(turns))}[name] > 0.9
    scattered = " ".join(w + " x" * 40 for w in "released under the mit license".split())
    assert scanner.scan(scattered) == []


def test_rows(spark):
    df = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0.", "l"), (2, None, "l"), (3, "", "l"), (None, "x", "l"), (1, "Licensed under CC BY-NC 4.0.", "l")], "doc_id long, text string, license string")
    got = sorted((r.doc_id or 0, r.license, r.coverage, r.licenses) for r in licenses.scanned(df).collect())
    assert got == [(0, None, 0.0, []), (1, "CC-BY-NC-4.0-notice", 1.0, ["CC-BY-NC-4.0-notice"]), (1, "CC-BY-NC-4.0-notice", 1.0, ["CC-BY-NC-4.0-notice"]), (2, None, 0.0, []), (3, None, 0.0, [])]
    assert licenses.scanned(df.limit(0)).collect() == []


def plain_scan(text):
    """Every template aligned with every stretch, nothing passed over."""
    own, found = licenses.words(text), {}
    for name, t in SPLIT.items():
        best = 0
        for at, step in enumerate(licenses.stretches(len(own), len(t))):
            for a, b in step:
                pairs = licenses.aligned(t, own[a:b])
                best = max(best, len(licenses._in_runs(pairs) if at == 2 and len(t) < licenses.SHORT else pairs))
        if best >= 0.8 * len(t):
            found[name] = best / len(t)
    return found


SPLIT = {n: licenses.words(t) for n, t in licenses.templates().items()}


def test_query_against_every_stretch(spark):
    docs = {r.doc_id: r.text or "" for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    rows = licenses.op6_license_scan(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    plain = 0
    for r in rows:
        if len(docs[r.doc_id]) < 2500:
            found = plain_scan(docs[r.doc_id])
            assert set(r.licenses) == set(found) and r.coverage == max(found.values(), default=0.0)
            plain += 1
    assert plain > 100 and any(r.licenses for r in rows)


def test_no_share_is_below_that_of_the_whole_text():
    rng, scanner = random.Random(5), licenses.Scanner()
    for name, t in SPLIT.items():
        for n in (0, 10, 60, 200, 500):
            # Words go, others come in at up to four places, and all of it lies in other text.
            own = [w for w in t if rng.random() > 0.05] if len(t) >= licenses.SHORT else list(t)
            for _ in range(4 if len(t) >= licenses.SHORT else 1):
                at = rng.randint(0, len(own))
                own[at:at] = [f"w{rng.randint(0, 30)}" for _ in range(n // 4)]
            own = ["the", "a"] * 20 + own + ["of", "this"] * 20
            pairs = licenses.aligned(t, own)
            share = len(licenses._in_runs(pairs) if len(t) < licenses.SHORT else pairs) / len(t)
            if share >= 0.8:
                assert {x[0]: x[1] for x in scanner.scan(" ".join(own))}[name] >= share


def test_a_very_long_text_and_clashing_columns(spark):
    long = " ".join(f"w{i % 999} the" for i in range(300_000))
    df = spark.createDataFrame([(1, long + " Released under the MIT License."), (2, "a" * 1_000_000)], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.first_word) for r in licenses.scanned(df).collect()}
    assert got == {1: ("MIT-notice", 600_000), 2: (None, None)}
    with pytest.raises(ValueError, match="license"):
        licenses.scanned(df.selectExpr("doc_id", "text", "1 AS license"), keep=("doc_id", "license"))
