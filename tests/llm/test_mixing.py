from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from forkscope.llm import common, mixing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 1 << 20)), min_size=1, max_size=7))
def test_less_than_one_block_from_the_fluid_schedule(sources):
    blocks, weights = [b for b, _ in sources], [w for _, w in sources]
    slots = mixing.schedule(blocks, weights)
    assert sorted(t for each in slots for t in each) == list(range(sum(blocks)))
    owner = {t: s for s, each in enumerate(slots) for t in each}
    # The fluid schedule, stepped by itself: share each slot among those with work left.
    fluid, got = [Fraction(0)] * len(blocks), [0] * len(blocks)
    for t in range(sum(blocks)):
        left = Fraction(1)
        while left:
            active = [s for s in range(len(blocks)) if fluid[s] < blocks[s]]
            total = sum(weights[s] for s in active)
            step = min([left, *((blocks[s] - fluid[s]) * total / Fraction(weights[s]) for s in active)])
            for s in active:
                fluid[s] += step * weights[s] / total
            left -= step
        got[owner[t]] += 1
        assert all(abs(f - g) < 1 for f, g in zip(fluid, got))
    assert all(each == sorted(each) for each in slots)


def check(rows, n):
    assert sorted(r.mix_position for r in rows) == list(range(n))
    at = Counter()
    for r in sorted(rows, key=lambda r: r.mix_position):
        assert at["slot"] <= r.mix_slot
        at["slot"] = r.mix_slot
        assert r.mix_source == r.source and r.mix_block == at[r.source] // 16
        at[r.source] += 1


def test_rows_without_source_or_key_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 20)
    rows = [(i % 200 if i % 9 else None, "ab"[i % 3 > 0] if i % 7 else None, i, "m") for i in range(500)] + [(1, "a", 1, "m")] * 5
    df = spark.createDataFrame(rows, "doc_id long, source string, slot int, first string").withColumn("mix_slot", F.lit("old"))
    got = mixing.mixed(df, {"a": 3.0, "b": 1.0}).collect()
    check(got, 505)
    assert Counter((r.doc_id, r.source, r.slot, r["first"]) for r in got) == Counter(rows)
    early = Counter(r.source for r in got if r.mix_slot < 8)
    assert early["a"] > early["b"]


def test_many_sources_share_pools(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SINGLE", 5)
    monkeypatch.setattr(mixing, "POOLS", 3)
    df = spark.createDataFrame([(i, f"s{i % 40}") for i in range(400)], "doc_id long, source string")
    got = mixing.mixed(df).collect()
    check(got, 400)
    assert {r.mix_source for r in got} == {f"s{i}" for i in range(40)}


def test_every_source_keeps_its_weight_beyond_the_largest(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SINGLE", 2)
    monkeypatch.setattr(mixing, "CELL_ROWS", 20)
    sizes = {"a": 900, "b": 800, "w": 300} | {f"s{i:02}": (40, 90)[i % 2] for i in range(30)}
    rows = [(s, i) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(rows)], "doc_id long, source string")
    weights = {"w": 400.0}
    got = sorted(mixing.mixed(df, weights).collect(), key=lambda r: r.mix_position)
    check(got, len(rows))
    assert Counter(r.source for r in got) == sizes
    # The fluid schedule of all sources by themselves, stepped by rows.
    share = {s: weights.get(s, n**0.5) for s, n in sizes.items()}
    left, fluid, seen = dict(sizes), Counter(), Counter()
    for r in got:
        seen[r.source] += 1
        rest = 1.0
        while rest > 1e-9:
            active = [s for s in left if left[s] - fluid[s] > 1e-6]
            if not active:
                break
            total = sum(share[s] for s in active)
            step = min([rest, *((left[s] - fluid[s]) * total / share[s] for s in active)])
            for s in active:
                fluid[s] += step * share[s] / total
            rest -= step
        # A block of 16 rows, and the one that is being read.
        assert all(abs(fluid[s] - seen[s]) < 32 for s in sizes)
        assert all(abs(fluid[s] - seen[s]) < 6 for s in sizes if s.startswith("s"))


def test_every_block_of_many_weighted_sources_against_the_fluid_schedule(spark):
    """More sources than SINGLE, all with target weights: each block lies in its window, and no source is ever a block away from its share."""
    n = mixing.SINGLE + 76
    sizes = [17 + 7 * (i % 13) for i in range(n)]
    weights = {f"s{i}": [0.5, 1.0, 3.0, 1000.0][i % 4 if i != 999 else 3] * (1 + i % 5) for i in range(n)}
    df = spark.createDataFrame([(100 * i + k, f"s{i}") for i in range(n) for k in range(sizes[i])], "doc_id long, source string")
    got = mixing.mixed(df, weights).collect()
    check(got, sum(sizes))
    blocks = np.array([-(-x // 16) for x in sizes])
    w = np.array([weights[f"s{i}"] for i in range(n)])
    slot = {}
    for r in got:
        assert slot.setdefault((int(r.source[1:]), r.mix_block), r.mix_slot) == r.mix_slot
    assert sorted(slot.values()) == list(range(blocks.sum())) and len(slot) == blocks.sum()
    owner = {t: k for k, t in slot.items()}
    fluid, seen = np.zeros(n), np.zeros(n)
    for t in range(blocks.sum()):
        left = 1.0
        while left > 1e-12:
            active = fluid < blocks - 1e-9
            if not active.any():
                break
            rate = np.where(active, w, 0) / w[active].sum()
            step = min(left, ((blocks - fluid)[active] / rate[active]).min())
            fluid, left = fluid + step * rate, left - step
        s, i = owner[t]
        assert seen[s] == i
        seen[s] += 1
        assert np.abs(fluid - seen).max() < 1 + 1e-6
    # The heaviest sources are out long before the lightest.
    ends = [max(t for (s, _), t in slot.items() if s == i) for i in (999, 1000)]
    assert ends[0] < ends[1]


def test_weights_of_zero_and_wrong_ones(spark):
    df = spark.createDataFrame([(i, "abz"[i % 3]) for i in range(300)], "doc_id long, source string")
    got = mixing.mixed(df, {"z": 0, "a": 1e-9, "b": 5}).collect()
    check(got, 300)
    last = {s: max(r.mix_slot for r in got if r.source == s) for s in "abz"}
    first = {s: min(r.mix_slot for r in got if r.source == s) for s in "abz"}
    assert last["b"] < last["a"] < first["z"]
    check(mixing.mixed(df, {"a": 0, "b": 0, "z": 0}).collect(), 300)
    for x in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="target weight"):
            mixing.mixed(df, {"a": x})


def test_groups_of_sizes():
    assert mixing.grouped([3, 1, 2], 3) == [1, 2, 3] and mixing.grouped([], 3) == []
    firsts = mixing.grouped(list(range(1, 5000)), 256)
    assert firsts[0] == 1 and len(firsts) <= 256


def test_none(spark):
    assert mixing.mixed(spark.createDataFrame([], "doc_id long, source string")).collect() == []


def test_query(spark):
    rows = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "source").collect()
    df = mixing.op10_mixing(spark, "/root/testdata/sf0.001")
    got = sorted(df.collect(), key=lambda r: r.mix_position)
    assert [r.mix_position for r in got] == list(range(len(rows))) and sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    # The schedule again by a plain search: in each slot the released block with the earliest deadline.
    sizes = Counter(r.source for r in rows)
    names = sorted(sizes)
    blocks = [-(-sizes[s] // 16) for s in names]
    weights = [Fraction(max(1, round(sizes[s] ** 0.5 / max(sizes.values()) ** 0.5 * mixing.PARTS))) for s in names]

    def slots_at(v):
        return sum(min(Fraction(n), v * w) for n, w in zip(blocks, weights))

    waiting = {(s, i): (slots_at(Fraction(i, w)).__floor__(), slots_at(Fraction(i + 1, w)).__ceil__()) for s, n, w in zip(names, blocks, weights) for i in range(n)}
    want = []
    for t in range(sum(blocks)):
        now = min((k for k in waiting if waiting[k][0] <= t), key=lambda k: (waiting[k][1], k))
        assert waiting.pop(now)[1] > t
        want.append(now)
    at = Counter()
    order = []
    for r in got:
        assert r.mix_block == at[r.source] // 16 and want[r.mix_slot] == (r.source, r.mix_block)
        at[r.source] += 1
        order.append(r.mix_slot)
    assert order == sorted(order)
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
