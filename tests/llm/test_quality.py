import numpy as np
import pytest
from pyspark.sql import functions as F

from forkscope.llm import common, quality, shingles


def test_gradient_of_the_fit():
    """The fitted thresholds ascend, and more of a bad feature lowers the grade."""
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(900):
        g = int(rng.integers(0, 3))
        own = set(rng.integers(100, 400, 20).tolist())
        if g == 0:
            own |= {1, 2}
        if g == 1:
            own |= {1}
        rows.append(np.array(sorted(own)))
        grades.append(g)
    m = quality.Ordinal.fitted(rows[:600], np.array(grades[:600]), 1000)
    assert (np.diff(m.thresholds) > 0).all()
    tails = m.tails(rows[600:])
    assert (tails[:, 0] >= tails[:, 1]).all()
    expected = tails.sum(1)
    assert np.mean(np.round(expected) == np.array(grades[600:])) > 0.9
    assert quality.Ordinal.fitted(rows[:3], np.array([1, 1, 1])) is None


def test_beginnings_like_slices():
    """Equal beginnings have equal hashes, others and whole words have different ones; words as long as a beginning have none."""
    texts = ["", "abcdefgh ABCDxyz abcd", "été étéétés abcdEFGH\nabcde", "日本語日本語日本 x"]
    hashes, owners = shingles.beginnings([t.encode() for t in texts], (4, 6), quality.WORD_BREAKS)
    want = [(w.lower()[:n], i) for n in (4, 6) for i, t in enumerate(texts) for w in t.split() if len(w) > n]
    assert owners.tolist() == [i for _, i in want]
    groups = {}
    for (begun, _), h in zip(want, hashes.tolist(), strict=True):
        groups.setdefault(begun, set()).add(h)
    assert all(len(h) == 1 for h in groups.values()) and len(set().union(*groups.values())) == len(groups)
    assert not set(hashes.tolist()) & set(shingles.words([b"abcd ABCDEF"])[0].tolist())
    assert len(shingles.beginnings([], (4,))[0]) == len(shingles.beginnings([b" "], (4,))[0]) == 0


def test_forms_that_no_labelled_text_has():
    """A word of the worst grade is known by its beginning."""
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("aeioulmn"), 6)) for _ in range(300)]
    text = lambda bad: " ".join([*rng.choice(plain, 30), *([f"zorr{''.join(rng.choice(list('aeioulmn'), 8))}" for _ in range(3)] if bad else [])])
    rows = [text(i % 4 == 0).encode() for i in range(2000)]
    grades = np.array([0 if i % 4 == 0 else 2 - (i % 8 == 1) for i in range(2000)])
    m = quality.Ordinal.fitted(quality.features(rows[:1600]), grades[:1600])
    low = m.tails(quality.features(rows[1600:]))[:, 0] < 0.5
    assert (low == (grades[1600:] == 0)).mean() > 0.98


def test_tails_by_hand():
    m = quality.Ordinal(np.array([0.5, -2.0, 0, 0]), np.array([-1.0, 1.0]))
    got = m.tails([np.array([0]), np.array([0, 1]), np.array([], int)])
    want = [[1 / (1 + np.exp(c - s)) for c in (-1.0, 1.0)] for s in (0.5, -1.5, 0.0)]
    assert got == pytest.approx(np.array(want))


def test_held_out(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0
    graded = {r.doc_id: r.grade for r in quality.grades(labels.where(held)).collect()}
    got = quality.scored(docs.select("doc_id", "text"), labels.where(~held)).join(quality.grades(labels.where(held)).select("doc_id"), "doc_id").collect()
    good = [r for r in got if graded[r.doc_id] == 2]
    bad = [r for r in got if graded[r.doc_id] < 2]
    kept = lambda rows: sum(r.tail_probability >= quality.LEAST_TAIL for r in rows) / len(rows)
    assert kept(good) > 0.97 and kept(bad) < 0.2
    pairs = [(a.expected_grade > b.expected_grade) for a in good[:200] for b in bad[:200]]
    assert sum(pairs) / len(pairs) > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (None, "good text", 0.0), (3, "x" * 100_000, 0.0), (3, "x" * 100_000, 0.0)], "doc_id long, text string, expected_grade double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.expected_grade for r in quality.scored(docs, none).collect()] == [None] * 5
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 1), (3, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, some)
    assert got.count() == 5 and all(r.tail_probability is not None for r in got.collect())
    assert quality.scored(docs.limit(0), some).collect() == []


def test_the_fit_takes_one_row_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(i % 5, f"word{i % 5} text {i}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    rows, grades = quality.sample(docs, quality.grades(labels))
    assert len(rows) == len(grades) == 5
    again, _ = quality.sample(docs.orderBy(F.rand(3)), quality.grades(labels))
    assert all((a == b).all() for a, b in zip(rows, again))


def test_query(spark):
    """Against the model applied text by text."""
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    model = quality.Ordinal.fitted(*quality.sample(docs, quality.grades(common.table(spark, "/root/testdata/sf0.001", "labels"))))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality.op9_quality(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        tails = model.tails(quality.features([texts[r.doc_id].encode()]))[0]
        assert r.expected_grade == pytest.approx(tails.sum()) and r.tail_probability == pytest.approx(tails[1]) and r.selected == (tails[1] >= quality.LEAST_TAIL)
