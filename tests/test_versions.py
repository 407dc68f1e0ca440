import hashlib
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forkscope.functions import native, states
from forkscope.operators import checkpoints, dedup, pieces, report, versions
from forkscope.plans import catalogue, runner, workload
from forkscope.plans.workload import Config, Kind
from forkscope.storage import dropped, stored


def random_graph(spark, seed, n, roots=2, base=300):
    rng = random.Random(seed)
    states_, version, edit, bases = [], [], [], []
    for i in range(n):
        if i < roots:
            states_.append(rng.randbytes(base) if i else b"")
            version.append((i, None, i))
            bases.append((i, states_[i]))
            continue
        p = rng.choice([i - 1, rng.randrange(i)])
        start = rng.randint(0, len(states_[p]))
        d = rng.randint(0, min(20, len(states_[p]) - start))
        ins = rng.randbytes(rng.choice([0, 3, 25]))
        states_.append(states_[p][:start] + ins + states_[p][start + d :])
        version.append((i, p, version[p][2]))
        edit.append((i, start, d, ins))
    return states_, spark.createDataFrame(version, "version_id long, parent_id long, root_id long"), spark.createDataFrame(edit, "version_id long, start long, delete_len long, insert binary"), spark.createDataFrame(bases, "root_id long, payload binary")


@pytest.fixture(scope="module")
def made(spark):
    return random_graph(spark, 4, 120)


def test_replay_like_plain_python(spark, made):
    want, *tables = made
    got = {r.version_id: bytes(r.state) for r in versions.replayed(*tables, strict=True).collect()}
    assert got == dict(enumerate(want))
    assert {r.version_id: r.len for r in versions.lengths(*tables).collect()} == {i: len(s) for i, s in enumerate(want)}


def test_piece_tables(spark, made):
    want, version, edit, base = made
    piece, buffers = pieces.piece_tables(version, edit, base)
    assert pieces.faults(piece, buffers).count() == 0
    assert buffers.count() == buffers.select("payload").distinct().count()
    rng = random.Random(1)
    reads = [(i, a, rng.randint(0, len(s) - a)) for i, s in enumerate(want) for a in [rng.randint(0, len(s))]] + [(i, 0, len(s)) for i, s in enumerate(want)]
    df = spark.createDataFrame(sorted(set(reads)), "version_id long, read_start long, read_len long")
    for r in pieces.read_ranges(df, piece, buffers).collect():
        assert bytes(r.bytes) == want[r.version_id][r.read_start : r.read_start + r.read_len]
    broken = piece.withColumn("len", F.when(F.col("ordinal") == 1, F.col("len") + 1).otherwise(F.col("len")))
    assert pieces.faults(broken, buffers).count() > 0


def test_equal_inserts_share_a_buffer(spark):
    version = spark.createDataFrame([(0, None, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0)], "version_id long, parent_id long, root_id long")
    edit = spark.createDataFrame([(1, 10, 0, b"z" * 8192), (2, 99, 5, b"z" * 8192), (3, 2048, 1, b"")], "version_id long, start long, delete_len long, insert binary")
    base = spark.createDataFrame([(0, b"x" * 4096)], "root_id long, payload binary")
    piece, buffers = pieces.piece_tables(version, edit, base)
    assert sorted(r.len for r in buffers.collect()) == [4096, 8192]
    assert piece.where("version_id = 3").count() == 2


def test_checkpoints(spark, made):
    want, version, edit, base = made
    flat = versions.replayed(version, edit, base)
    log, kept = checkpoints.delta_log(version, edit, flat, every=3)
    got = {r.version_id: bytes(r.state) for r in checkpoints.restored(version, log, kept).collect()}
    assert got == dict(enumerate(want))


def test_restored_needs_the_full_states_no_longer(spark, made):
    want, version, edit, base = made
    flat = stored(versions.replayed(version, edit, base), "flat")
    log, kept = checkpoints.delta_log(version, edit, flat, every=3)
    back = checkpoints.restored(version, stored(log, "log"), kept)
    dropped(flat)
    assert {r.version_id: bytes(r.state) for r in back.collect()} == dict(enumerate(want))


def plain_composed(first, then):
    """Slices by bytes: each byte of the result by itself."""
    every = [(s, a + i) for s, a, n in first for i in range(min(n, 600))]
    return [every[a + i] if s == native.ABOVE else (s, a + i) for s, a, n in then for i in range(min(n, max(0, len(every) - a) if s == native.ABOVE else n))]


@given(st.lists(st.tuples(st.sampled_from([native.ABOVE, 1, 2]), st.integers(0, 20), st.integers(0, 9)), max_size=6), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 15), st.integers(0, 4)), max_size=5))
def test_composed_slices(first, edits):
    first = [x for x in first if x[2]] + [(native.ABOVE, 30, native.REST)]
    then = []
    at = 0
    for gap, size, insert in edits:
        then += [(native.ABOVE, at, gap), (7, 0, insert)]
        at += gap + size
    then.append((native.ABOVE, at, native.REST))
    got = native.composed(np.array(first, np.int64).reshape(-1, 3), np.array(then, np.int64).reshape(-1, 3))
    assert got[-1].tolist()[2] == native.REST and (got[:, 2] > 0).all()
    spell = [(s, a + i) for s, a, n in got.tolist() for i in range(min(n, 600))]
    want = plain_composed(first, then)
    assert spell[:300] == want[:300]


def test_many_rows_composed_like_each():
    rng = np.random.default_rng(3)

    def row(whole):
        x = np.array([[rng.choice([native.ABOVE, 1, 2]), rng.integers(0, 30), rng.integers(0, 9)] for _ in range(rng.integers(0, 6))], np.int64).reshape(-1, 3)
        return np.concatenate([x, [[native.BASE, 0, whole]]]) if whole is not None else np.concatenate([x, [[native.ABOVE, rng.integers(0, 40), native.REST]]])

    for far in (0, 2**62):
        first, then = [row(rng.choice([None, 0, 7])) for _ in range(300)], [row(None) for _ in range(300)]
        then[7][-1, 1] += far
        first = [x[x[:, 2] > 0] for x in first]
        got, many = native.composed_rows(np.concatenate(first), np.array([len(x) for x in first]), np.concatenate(then), np.array([len(x) for x in then]))
        want = [native.composed(a, b) for a, b in zip(first, then)]
        assert many.tolist() == [len(x) for x in want] and got.tolist() == np.concatenate(want).tolist()


def test_replay_in_many_groups(spark, made, monkeypatch):
    want, *tables = made
    monkeypatch.setattr(versions, "GROUP", 2000)
    got = {r.version_id: bytes(r.state) for r in versions.replayed(*tables, strict=True).collect()}
    assert got == dict(enumerate(want))


def test_replayed_states_take_the_room_of_their_payloads(spark, tmp_path):
    """150 versions, each its parent and 4 KiB more: 45 MB of states from 0.6 MB."""
    rng = random.Random(5)
    texts = [rng.randbytes(4096) for _ in range(150)]
    version = spark.createDataFrame([(i, i - 1 if i else None, 0) for i in range(150)], "version_id long, parent_id long, root_id long")
    edit = spark.createDataFrame([(i, i % 60, 0, texts[i]) for i in range(1, 150)], "version_id long, start long, delete_len long, insert binary")
    flat = versions.replayed(version, edit, spark.createDataFrame([(0, texts[0])], "root_id long, payload binary"))
    assert checkpoints.reopened_mismatches(spark, str(tmp_path / "states"), flat).count() == 0
    assert sum(f.stat().st_size for f in (tmp_path / "states").iterdir()) < 10 << 20


def test_chunks_and_pieces_in_groups(spark, made):
    want, version, edit, base = made
    flat = stored(versions.replayed(version, edit, base).select("version_id", "state").unionByName(spark.createDataFrame([(-1, b""), (-2, None)], "version_id long, state binary")), "flat")
    manifest, chunks = dedup.grouped_chunks(flat, "version_id", "state", 64, 2000)
    assert manifest.select("group").distinct().count() > 4
    store = stored(dedup.grouped_store(chunks), "store")
    assert store.select("digest").distinct().count() == store.count() == chunks.select("digest").distinct().count() < chunks.count()
    rows = dedup.chunk_manifest(flat, "version_id", "state", 64)
    assert {bytes(r.digest).hex() for r in store.collect()} == {r.digest for r in rows.collect()}
    expected = dict(enumerate(want)) | {-1: b"", -2: None}
    got = lambda df: {r.version_id: None if r.state is None else bytes(r.state) for r in df.collect()}
    assert got(dedup.grouped_states(manifest, store, "version_id")) == expected
    piece, buffers = pieces.piece_tables(version, edit, base)
    places = manifest.select("version_id", "group", "at", "len")
    assert got(pieces.whole(places, piece, buffers)) == expected
    for df in (dedup.grouped_states(manifest, store, "version_id", digests=True), pieces.whole(places, piece, buffers, digests=True), manifest.withColumnRenamed("state_digest", "digest")):
        assert versions.differing(versions.digests(flat), df).count() == 0
    # What lacks a chunk or a buffer is no state, and a changed one is another.
    one = store.orderBy(F.size("groups").desc()).first()
    lost = got(dedup.grouped_states(manifest, store.where(F.col("digest") != F.lit(bytes(one.digest))), "version_id"))
    assert any(s is None and expected[k] is not None for k, s in lost.items()) and all(s is None or s == expected[k] for k, s in lost.items())
    base_id = piece.where("version_id = 1").first().buffer_id
    lost = got(pieces.whole(places, piece, buffers.where(F.col("buffer_id") != base_id)))
    assert lost[1] is None and lost[0] == b"" and all(s is None or s == expected[k] for k, s in lost.items())
    changed = buffers.withColumn("payload", F.when(F.col("buffer_id") == base_id, F.concat(F.lit(b"?"), F.expr("substring(payload, 2)"))).otherwise(F.col("payload")))
    wrong = versions.mismatches(flat, pieces.whole(places, piece, changed)).select("version_id").collect()
    assert 1 in {r.version_id for r in wrong}


def test_equivalence_moves_payloads_and_not_states(spark, monkeypatch):
    """150 versions, each its parent and 4 KiB more: 45 MB of states from 0.6 MB."""
    rng = random.Random(6)
    texts = [rng.randbytes(4096) for _ in range(150)]
    version = spark.createDataFrame([(i, i - 1 if i else None, 0) for i in range(150)], "version_id long, parent_id long, root_id long")
    edit = spark.createDataFrame([(i, i % 60, 0, texts[i]) for i in range(1, 150)], "version_id long, start long, delete_len long, insert binary")
    monkeypatch.setattr(catalogue, "graph", lambda *_: {"version": version, "edit": edit, "base": spark.createDataFrame([(0, texts[0])], "root_id long, payload binary")})

    def moved():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = moved()
    assert catalogue.equivalence(spark, "").collect() == [(150, 0)]
    assert moved() - before < 20 << 20


def test_a_chain_of_20000_versions(spark):
    """Every version edits the one before: 15 rounds, and no list of ancestors anywhere."""
    rng = random.Random(8)
    n, state = 20_000, bytes(range(120))
    digests, edit = {0: hashlib.md5(state).hexdigest()}, []
    base = state
    for i in range(1, n):
        start = rng.randint(0, len(state))
        cut = min(rng.randint(0, 6), len(state) - start)
        ins = rng.randbytes(rng.randint(0, 6 if len(state) < 200 else 2))
        state = state[:start] + ins + state[start + cut :]
        digests[i] = hashlib.md5(state).hexdigest()
        edit.append((i, start, cut, ins))
    version = spark.range(n).select(F.col("id").alias("version_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(0).cast("long").alias("root_id"))
    edit = spark.createDataFrame(edit, "version_id long, start long, delete_len long, insert binary")
    bases = spark.createDataFrame([(0, base)], "root_id long, payload binary")
    got = versions.replayed(version, edit, bases, strict=True).select("version_id", "depth", F.md5("state").alias("m")).collect()
    assert {r.version_id: r.m for r in got} == digests and all(r.depth == r.version_id for r in got)
    assert versions.lengths(version, edit, bases).where("len IS NULL").count() == 0


def test_edits_out_of_bounds(spark):
    version = spark.createDataFrame([(0, None, 0), (1, 0, 0), (2, 1, 0), (3, 2, 0), (4, 0, 0), (5, 4, 0), (6, 0, 0), (7, 0, 0)], "version_id long, parent_id long, root_id long")
    edit = spark.createDataFrame([(1, 0, 0, b"abcdef"), (2, 8, 3, b""), (3, 0, 0, b"x"), (4, 5, 0, b"y"), (5, -1, 0, b""), (6, 0, 2**62, b""), (7, 4, 0, None)], "version_id long, start long, delete_len long, insert binary")
    base = spark.createDataFrame([(0, b"base")], "root_id long, payload binary")
    got = {r.version_id: r.state and bytes(r.state) for r in versions.replayed(version, edit, base).collect()}
    # 2 needs 11 bytes of 10, so 3 has no state either; 4 begins behind the end of its parent.
    assert got == {0: b"base", 1: b"abcdefbase", 2: None, 3: None, 4: None, 5: None, 6: None, 7: None}
    assert {r.version_id: r.len for r in versions.lengths(version, edit, base).collect()} == {i: s and len(s) for i, s in got.items()}
    with pytest.raises(Exception, match="edit/range out of bounds"):
        versions.replayed(version, edit, base, strict=True).collect()
    piece, buffers = pieces.piece_tables(version, edit, base)
    assert {r.version_id for r in piece.collect()} == {0, 1} and pieces.faults(piece, buffers).count() == 0


def test_siblings_never_see_each_other(spark):
    got = {r.version_id: r.state_text for r in __import__("forkscope.plans.catalogue", fromlist=["x"]).sibling_fork(spark, "").collect()}
    assert got == {0: "base", 1: "base-a", 2: "base-a-b", 3: "base-c"}


def test_a_failed_mode_is_a_result():
    assert checkpoints.outcome("delta", lambda: 1 / 0)["semantic_pass"] is False
    assert checkpoints.outcome("plain", lambda: {"rows": 1}) == {"mode": "plain", "semantic_pass": True, "semantic_error": None, "rows": 1}


def test_schema_and_counts(spark):
    checkpoints.reset_schema(spark, "fs_test")
    assert checkpoints.row_counts(spark, ["fs_test.none"]) == {"fs_test.none": 0}
    spark.sql("DROP SCHEMA fs_test CASCADE")


def test_mismatches_are_found(spark):
    a = spark.createDataFrame([(1, b"x"), (2, b"y")], "version_id long, state binary")
    b = spark.createDataFrame([(1, b"x"), (2, b"z"), (3, b"")], "version_id long, state binary")
    assert sorted(r.version_id for r in versions.mismatches(a, b).collect()) == [2, 3]
    assert versions.mismatches(a, a).count() == 0


@pytest.mark.parametrize(("total", "samples", "want"), [(0, 5, []), (1, 5, [0]), (2, 1, [0, 1]), (10, 4, [0, 3, 6, 9]), (5, 16, [0, 1, 2, 3, 4])])
def test_sample_indices(spark, total, samples, want):
    assert spark.range(1).select(versions.sample_indices(F.lit(total).cast("long"), samples)).first()[0] == want


def test_percentiles(spark):
    values = [(g, v) for g, n in (("a", 24), ("b", 1), ("c", 100)) for v in range(n)] + [("d", None)]
    got = {r.g: (r.p50, r.p95, r.p99) for r in report.percentiles(spark.createDataFrame(values, "g string, v long"), ["g"], "v").collect()}
    assert got == {"a": (11, 21, 22), "b": (0, 0, 0), "c": (49, 94, 98)}


GOLDEN = [  # logical bytes, growth per branch of interned pieces and of chunks
    (Config(Kind.SMALL_EDIT, 128, 256 << 10, 96), 33_814_495, 662.484, 23_002.570),
    (Config(Kind.SMALL_EDIT), 2_099_239_526, 892.645, None),
    (Config(Kind.APPEND_HEAVY, 1000, 2 << 20, 512), 2_104_035_180, None, None),
    (Config(Kind.CROSS_TEMPLATE, 500, 2 << 20, 64 << 10), 1_064_785_800, 2_816.672, None),
    (Config(Kind.LARGE_REWRITE, 500, 8 << 20, 64 << 10), 4_202_692_608, 67_986.304, None),
]

NODE = 48  # bytes of one node of the interned representation, with which the published growth was counted


@pytest.mark.parametrize(("config", "logical", "pieces_growth", "chunks_growth"), GOLDEN)
def test_plans_have_the_published_sizes(config, logical, pieces_growth, chunks_growth):
    w = workload.plan(config)
    assert w.logical_bytes == logical
    for s, n, i in zip(w.steps, w.lengths[1:], range(len(w.steps))):
        assert s.parent <= i and w.lengths[s.parent] - s.delete_len + len(s.insert) == n and s.read_start + s.read_len <= n
    if pieces_growth:
        payload = sum(map(len, {s.insert for s in w.steps})) / len(w.steps)
        nodes = (pieces_growth - payload) / NODE * len(w.steps)
        assert nodes == pytest.approx(round(nodes), abs=0.02) and nodes > 0  # what is left is a whole number of nodes


def test_small_workload_in_all_representations(spark):
    found = runner.run_workload(spark, GOLDEN[0][0])
    reports = {r["name"]: r for r in found["reports"]}
    assert found["read_checksum"] == "fe511afe3aa832ba" and found["logical_bytes"] == 33_814_495
    assert reports[runner.CHUNKS]["growth_per_branch"] == pytest.approx(23_002.570, abs=0.001)
    w = workload.plan(GOLDEN[0][0])
    assert reports[runner.PIECES]["growth"] == sum(map(len, {s.insert for s in w.steps}))


def test_template_catalogue():
    w = workload.plan(Config(Kind.CROSS_TEMPLATE, 32, 8192, 2048, 512, seed=11))
    assert 2 <= len({s.insert for s in w.steps}) <= 4


def test_growth_is_never_negative(spark):
    row = spark.range(1).select(dedup.growth(F.lit(3), F.lit(5)), dedup.per_branch(F.lit(10), F.lit(0)), states.state_len(F.lit(b"abc"))).first()
    assert tuple(row) == (0, 10.0, 3)
