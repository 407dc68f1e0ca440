import random

import pytest
from pyspark.sql import functions as F

from forkscope.functions import native, states
from forkscope.operators import corpus, dedup, pieces, prepare
from forkscope.operators.ranks import ranked
from forkscope.plans import runner
from forkscope.sources import manifests


def pack(files):
    return native.write_pack([(1, 0o644, p.encode(), c) for p, c in files.items()])


def pairs(spark, rows):
    return spark.createDataFrame([(f"c{i}", a, b) for i, (a, b) in enumerate(rows)], "case_id string, base binary, child binary")


def test_scripts_rebuild_children(spark):
    rng = random.Random(7)
    rows = [(b"alpha-OLD-middle-tail", b"alpha-NEW-and-longer-middle-tail"), (b"same", b"same"), (b"", b"x"), (b"x", b""), (pack({"a": b"1"}), b"no pack"), (pack({}), pack({})), (pack({"a": b"1"}), pack({})), (pack({}), pack({"a": b"1"}))]
    for _ in range(25):
        names = [f"{rng.randrange(30):02}/f" for _ in range(8)]
        base = {n: rng.randbytes(rng.randrange(40)) for n in names}
        child = {n: c if rng.random() < 0.5 else rng.randbytes(5) for n, c in base.items() if rng.random() < 0.8} | {f"{rng.randrange(30):02}/g": b"new" for _ in range(rng.randrange(3))}
        rows.append((pack(base), pack(child)))
    scripts = corpus.derived(pairs(spark, rows), "case_id")
    assert corpus.unfaithful(scripts).count() == 0
    got = {r.case_id: r.script for r in scripts.collect()}
    assert len(got["c0"]) == 1 and got["c1"] == [] and got["c5"] == [] and len(got["c4"]) == 1
    for script in got.values():
        keys = [(-e.start, -e.delete_len) for e in script]
        assert keys == sorted(keys)


def test_distant_files_make_two_small_edits(spark):
    body = b"m" * 3000
    a, b = pack({"a": b"old head", "k": body, "z": b"old tail"}), pack({"a": b"new head", "k": body, "z": b"new tail"})
    script = corpus.derived(pairs(spark, [(a, b)]), "case_id").first().script
    assert len(script) == 2 and sum(len(e.insert) for e in script) < 64


def test_cases_and_reads(spark):
    rows = corpus.cases(corpus.derived(pairs(spark, [(b"abc", b"abcd"), (b"a", b"")]), "case_id"), "case_id", read_bytes=2).collect()
    got = {r.case_id: r for r in rows}
    assert (got["c0"].read_len, got["c0"].hunks, got["c0"].child_len) == (2, 1, 4) and got["c0"].read_start == native.fnv1a(b"c0") % 3
    assert (got["c1"].read_len, got["c1"].read_start) == (0, 0)


def test_run_corpus(spark, monkeypatch):
    files = {f"{i:02}": b"%d" % i * 300 for i in range(9)}
    rows = [(b"x" * 5000, b"x" * 4000 + b"y" * 100), (b"x" * 5000, b"x" * 5000), (pack(files), pack(files | {"03": b"new", "07": b"other", "99": b"more"})), (b"", b"")]
    found = runner.run_corpus(pairs(spark, rows), average=256, read_bytes=64, verify_samples=2, leaf=100)
    got = {r["name"]: r for r in found["reports"]}
    a, b = len(rows[2][0]), len(rows[2][1])
    assert found["cases"] == 4 and found["logical_bytes"] == 19_100 + a + b and got[runner.FLAT]["final_bytes"] == 19_100 + a + b
    # Two files changed, one came, and the number of files.
    assert found["edit_hunks"] == 5 and got[runner.PIECES]["base_bytes"] == 5000 + a and 5100 + a < got[runner.PIECES]["final_bytes"] < 5200 + a
    assert got[runner.CHUNKS]["base_bytes"] < 10_000 + a and got[runner.CHUNKS]["lifetime_bytes"] > got[runner.CHUNKS]["final_bytes"]
    assert len(found["verified_versions"]) == 2 and found["verified_versions"][-1] == 3 * runner.STEPS
    h = native.FNV_START
    for r in sorted(corpus.cases(corpus.derived(pairs(spark, rows), "case_id"), "case_id", 64).collect(), key=lambda r: r.case_id):
        h = native.fnv1a(bytes(r.child)[r.read_start : r.read_start + r.read_len], h)
    assert found["read_checksum"] == f"{h:016x}"
    assert runner.run_corpus(pairs(spark, rows).limit(0))["cases"] == 0


def test_differences_between_representations_are_found(spark):
    flat = spark.createDataFrame([(i, bytes([i]) * 500, 500) for i in range(9)], "version_id long, state binary, len long")
    version = spark.createDataFrame([(i, None, i) for i in range(9)], "version_id long, parent_id long, root_id long")
    bases = flat.selectExpr("version_id AS root_id", "state AS payload")
    none = spark.createDataFrame([], "version_id long, start long, delete_len long, insert binary")
    piece, buffers = pieces.piece_tables(version, none, bases)
    piece = pieces.cut(piece, 64)
    assert piece.where("len > 64").count() == 0 and pieces.faults(piece, buffers, 64).count() == 0
    manifest = dedup.chunk_manifest(flat, "version_id", "state", 64)
    assert runner.verified(flat, piece, buffers, manifest, 3, 64) == [0, 4, 8]
    other = buffers.withColumn("payload", F.overlay("payload", F.lit(b"?"), F.lit(7)))
    with pytest.raises(ValueError, match="semantic mismatch at sampled version .* interned-pieces"):
        runner.verified(flat, piece, other, manifest, 3, 64)
    with pytest.raises(ValueError, match="version 2 length mismatch: expected=500, content-chunks"):
        runner.verified(flat, piece, buffers, manifest.where("version_id <> 2 OR ordinal > 0"), 3, 64)
    with pytest.raises(ValueError, match="pieces break an invariant"):
        runner.verified(flat, piece, buffers, manifest, 3, 63)
    swapped = manifest.withColumn("ordinal", F.when(F.col("version_id") == 4, 1 - F.col("ordinal")).otherwise(F.col("ordinal")))
    with pytest.raises(ValueError, match="chunks break an invariant"):
        runner.verified(flat, piece, buffers, swapped, 3, 64)


def test_identical_states_add_no_chunk(spark):
    df = spark.createDataFrame([(1, b"x" * 8192), (2, b"x" * 8192), (3, b"")], "k long, s binary")
    manifest = dedup.chunk_manifest(df, "k", "s")
    one = dedup.chunk_stats(manifest.where("k = 1")).first()
    both = dedup.chunk_stats(manifest).first()
    assert both.payload_bytes == one.payload_bytes and both.references == 2 * one.references
    sizes = df.select("k", states.state_len("s").alias("len"))
    assert dedup.manifest_faults(manifest, sizes, "k").count() == 0
    assert dedup.manifest_faults(manifest.where("ordinal <> 0"), sizes, "k").count() == 2


def test_files_and_back(spark, tmp_path, monkeypatch):
    (tmp_path / "b").write_bytes(pack({"f": b"1"}))
    (tmp_path / "c").write_bytes(pack({"f": b"2"}))
    lines = "# id\tbase\tchild\n\n   \nx\tb\t" + str(tmp_path / "c") + "\tmore \n"
    (tmp_path / "m.tsv").write_text(lines)
    row = manifests.read_pairs(spark, str(tmp_path / "m.tsv")).first()
    assert row.case_id == "x" and native.parse_pack(bytes(row.child))[0]["content"] == b"2"
    assert manifests.folder_bytes(spark, str(tmp_path)) == sum(f.stat().st_size for f in tmp_path.iterdir())
    entries = manifests.read_packs(spark, str(tmp_path / "b")).collect()
    assert [(bytes(e.path), bytes(e.content)) for e in entries] == [(b"f", b"1")]
    (tmp_path / "bad.tsv").write_text("x\ty\n")
    with pytest.raises(Exception, match="must contain"):
        manifests.parsed(spark.read.text(str(tmp_path / "bad.tsv"))).collect()
    (tmp_path / "later.tsv").write_text("# head\n\na\tb\tc\r\nx\ty\n")
    with pytest.raises(Exception, match="manifest line 4 must contain"):
        manifests.read_manifest(spark, str(tmp_path / "later.tsv")).collect()
    monkeypatch.setattr(manifests, "LISTED", 1)
    assert manifests.read_pairs(spark, str(tmp_path / "m.tsv")).first() == row
    (tmp_path / "none.tsv").write_text("# nothing\n")
    with pytest.raises(ValueError):
        manifests.read_manifest(spark, str(tmp_path / "none.tsv"))
    out = manifests.manifest_lines(spark.createDataFrame([("a", "b", "c")], "case_id string, base_path string, child_path string"), ["case_id", "base_path", "child_path"])
    assert [r.value for r in out.collect()] == ["# case_id\tbase_path\tchild_path", "a\tb\tc"]
    manifests.write_json(out, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_packs_of_rows(spark):
    df = spark.createDataFrame([("s", 1, 5, b"b", b"2"), ("s", 2, 6, b"a", b"1")], "k string, kind int, mode long, path binary, content binary")
    entries = native.parse_pack(bytes(manifests.packs(df, "k").first().pack))
    assert [(e["path"], e["kind"], e["mode"], e["content"]) for e in entries] == [(b"a", 2, 6, b"1"), (b"b", 1, 5, b"2")]


def test_ranks_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "hot", "b", None, ""]), rng.random()) for i in range(400)]
    got = ranked(spark.createDataFrame(rows, "i long, g string, v double"), ["g"], ["v"]).collect()
    want = {}
    for i, g, _ in sorted(rows, key=lambda r: r[2]):
        want[i] = sum(1 for x in want if rows[x][1] == g)
    assert {r.i: r["rank"] for r in got} == want
    every = ranked(spark.createDataFrame(rows, "i long, g string, v double"), [], ["v"], "p").collect()
    assert [r.i for r in sorted(every, key=lambda r: r.p)] == [i for i, _, _ in sorted(rows, key=lambda r: r[2])]


def test_round_robin(spark):
    rows = [(i, r) for i, r in enumerate("aabacab")]
    df = spark.createDataFrame(rows, "pos long, repo string")
    got = [r.pos for r in prepare.round_robin(df, "repo", "pos").orderBy("place").collect()]
    assert got == [0, 2, 4, 1, 6, 3, 5]
    some = spark.createDataFrame([(0, None), (1, "a"), (2, None)], "pos long, repo string")
    assert [(r.pos, r.turn, r.place) for r in prepare.round_robin(some, "repo", "pos").orderBy("place").collect()] == [(0, 0, 0), (1, 0, 1), (2, 1, 2)]
    assert [r.pos for r in prepare.selected(df, "round-robin", "repo", "pos", 2, 3).collect()] == [4, 1, 6]
    assert [r.pos for r in prepare.selected(df, "sequential", "repo", "pos", 2, 3).collect()] == [2, 3, 4]
    assert [r.repo for r in prepare.distinct_in_order(df, "repo", "pos").collect()] == ["a", "b", "c"]
    assert prepare.checked_count(df, 7) is df
    with pytest.raises(ValueError):
        prepare.checked_count(df, 6)
    with pytest.raises(ValueError):
        prepare.selected(df, "other", "repo", "pos", 0, 1)


def test_paths_are_sorted_by_bytes_and_conflicts_fail(spark):
    df = spark.createDataFrame([("é", 0), ("z", 0), ("Z", 0)], "path string, stage int")
    assert [bytes(r.path).decode() for r in prepare.by_path(df, "path").collect()] == ["Z", "z", "é"]
    with pytest.raises(Exception, match="unmerged path"):
        prepare.by_path(df.withColumn("stage", F.lit(2)), "path").collect()
