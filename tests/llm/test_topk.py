import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from forkscope.llm import common, topk


def cut(x):
    return max(-(2**63), min(2**63 - 1, x))


def brute(rows, k, every):
    best = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            v = [int(float(cut(math.floor(64 * x)))) for x in e]
            best[i] = min(best.get(i, v), v)
    out = []
    for q, a in best.items():
        if q % every == 0:
            found = sorted((-cut(sum(x * y for x, y in zip(a, b))), i) for i, b in best.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=3, every=2):
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, score int")
    return sorted(tuple(r) for r in topk.top_k(df, k, every).collect())


def test_ties_nulls_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.5, 0.25, -0.5, 0.125]) for i in range(12)] + [(20, None), (21, [1.0, None]), (22, [nan]), (24, [inf, 1.0]), (None, [1.0]), (26, []), (28, [2.0]), (30, [-1.0] * 7), (2, [0.0, 0.0]), (4, [0.5, 0.25, -0.5, 0.125])]
    assert run(spark, rows) == brute(rows, 3, 2)


def test_values_beyond_double(spark):
    rows = [(i, [2.0**70 * (i - 3), -(2.0**40) * i, 1.5]) for i in range(8)]
    assert run(spark, rows) == brute(rows, 3, 2)


def test_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0]), (3, [2.0])]) == []
    assert run(spark, [(2, [1.0])]) == []


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.lists(st.sampled_from([-1.0, -0.3, 0.0, 0.2, 0.9]), min_size=5, max_size=5)), min_size=1, max_size=60))
def test_any(spark, rows):
    assert run(spark, rows) == brute(rows, 3, 2)


def test_many_cells_and_blocks(spark, monkeypatch):
    rows = [(r.vec_id, r.embedding) for r in common.table(spark, "/root/testdata/sf0.001", "embeddings").collect()]
    # Cells of about six vectors, blocks of about six queries, strips of a few scores.
    monkeypatch.setattr(topk, "CELL_BYTES", 6 * 4 * len(rows[0][1]))
    monkeypatch.setattr(topk, "SCORES", 20)
    assert run(spark, rows, 20, 20) == brute(rows, 20, 20)
