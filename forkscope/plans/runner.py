"""Runs of the three representations over a workload or a corpus, their checks and their reports."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native, states
from ..operators import corpus as c
from ..operators import dedup, pieces, report
from ..operators import versions as v
from ..operators.ranks import ranked
from ..storage import stored
from .workload import Config, Workload, plan

FLAT, PIECES, CHUNKS = "full-states", "interned-pieces", "content-chunks"
PAIRS = [(FLAT, PIECES), (PIECES, CHUNKS), (FLAT, CHUNKS)]


def read_checksum(reads: DataFrame, order: str = "version_id") -> int:
    """FNV-1a over all read bytes in order. Each byte's step needs the one before, so one task folds the sorted stream; nothing is held."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = native.FNV_START
        for batch in batches:
            for data in batch.column("bytes"):
                h = native.fnv1a(data.as_py() or b"", h)
        yield pa.RecordBatch.from_arrays([pa.array([h - (1 << 64) if h >> 63 else h], pa.int64())], ["h"])

    rows = reads.select(order, "bytes").repartition(1).sortWithinPartitions(order).select("bytes")
    found = rows.mapInArrow(fold, "h long").first()
    return found["h"] % (1 << 64) if found else native.FNV_START


def verified(flat: DataFrame, piece: DataFrame, buffers: DataFrame, manifest: DataFrame, samples: int, leaf: int | None = None) -> list[int]:
    """Compares all representations of flat (version_id, state, len as planned); returns the sampled versions.

    All lengths, and the structure and the whole bytes of evenly spaced samples,
    among them the first and the last version. A difference is an error.
    """
    for name, sizes in ((FLAT, flat.select("version_id", F.octet_length("state").alias("n"))), (PIECES, piece.groupBy("version_id").agg(F.sum("len").alias("n"))), (CHUNKS, manifest.groupBy("version_id").agg(F.sum("len").alias("n")))):
        wrong = flat.join(sizes, "version_id", "left").where(F.col("len") != F.coalesce("n", F.lit(0))).select("version_id", "len", "n").first()
        if wrong:
            raise ValueError(f"version {wrong[0]} length mismatch: expected={wrong[1]}, {name}={wrong[2]}")
    spark = flat.sparkSession
    total = flat.count()
    places = spark.range(1).select(F.explode(v.sample_indices(F.lit(total).cast("long"), samples)).alias("place"))
    chosen = ranked(flat.select("version_id"), [], ["version_id"], "place").join(places, "place").select("version_id")
    chosen = stored(chosen, "samples")
    some = stored(flat.join(chosen, "version_id").select("version_id", "state"), "sampled")
    some_pieces, some_chunks = piece.join(chosen, "version_id"), manifest.join(chosen, "version_id")
    if pieces.faults(some_pieces, buffers, leaf).limit(1).count():
        raise ValueError("a sampled version's pieces break an invariant")
    if dedup.manifest_faults(some_chunks, some.select("version_id", F.octet_length("state").alias("len")), "version_id").limit(1).count():
        raise ValueError("a sampled version's chunks break an invariant")
    whole = some.select("version_id", F.lit(0).cast("long").alias("read_start"), states.state_len("state").alias("read_len"))
    from_pieces = pieces.read_ranges(whole, some_pieces, buffers).select("version_id", F.col("bytes").alias("state"))
    # The store is cut from the states of all versions, the first that holds a chunk.
    store = dedup.chunk_store(manifest.join(some_chunks.select("digest").distinct(), "digest", "left_semi"), flat, "version_id", "state")
    from_chunks = some.select("version_id").join(dedup.rebuilt(some_chunks, store, "version_id"), "version_id", "left").withColumn("state", F.coalesce("state", F.lit(b"")))
    for name, other in ((PIECES, from_pieces), (CHUNKS, from_chunks)):
        wrong = v.mismatches(some, other).first()
        if wrong:
            raise ValueError(f"semantic mismatch at sampled version {wrong['version_id']}: {FLAT} and {name}")
    return sorted(r[0] for r in chosen.collect())  # as many as asked for


def run_workload(spark: SparkSession, config: Config, average: int = 4096, leaf: int = 4096) -> dict:
    """Builds a workload's versions in all representations, checks that they agree, and returns one report each."""
    workload: Workload = plan(config)
    t = workload.tables(spark)
    began = time.time()
    states_of = stored(v.replayed(t["version"], t["edit"], t["base"], strict=True), "states")
    replay_s = time.time() - began
    began = time.time()
    piece, buffers = pieces.piece_tables(t["version"], t["edit"], t["base"])
    piece = pieces.cut(piece, leaf)
    pieces_s = time.time() - began
    began = time.time()
    manifest = stored(dedup.chunk_manifest(states_of.select("version_id", "state"), "version_id", "state", average), "manifest")
    chunks_s = time.time() - began
    flat = states_of.select("version_id", "state").join(t["version"].select("version_id", "len"), "version_id")
    sampled = verified(flat, piece, buffers, manifest, config.verify_samples, leaf)
    reads = stored(pieces.read_ranges(t["read_plan"], piece, buffers), "reads")
    direct = states_of.join(t["read_plan"], "version_id").withColumn("bytes", states.read_range("state", "read_start", "read_len"))
    differ = reads.select("version_id", F.col("bytes").alias("a")).join(direct.select("version_id", F.col("bytes").alias("b")), "version_id").where(~F.col("a").eqNullSafe(F.col("b"))).count()
    if differ:
        raise ValueError(f"{differ} reads differ between representations")
    base_len = len(workload.base)
    total = lambda df, col: int(df.agg(F.coalesce(F.sum(col), F.lit(0))).first()[0])
    first = dedup.chunk_stats(manifest.where("version_id = 0")).first()
    last = dedup.chunk_stats(manifest).first()
    branches = max(1, config.branches)
    sizes = {
        FLAT: (base_len, workload.logical_bytes, replay_s),
        PIECES: (base_len, total(buffers, "len"), pieces_s),
        CHUNKS: (first["payload_bytes"] + first["metadata_bytes"], last["payload_bytes"] + last["metadata_bytes"], chunks_s),
    }
    return {
        "kind": config.kind.value, "versions": len(workload.lengths), "logical_bytes": workload.logical_bytes, "read_checksum": f"{read_checksum(reads):016x}", "verified_versions": sampled,
        "reports": [{"name": n, "base_bytes": a, "final_bytes": b, "growth": max(0, b - a), "growth_per_branch": max(0, b - a) / branches, "seconds": round(s, 3)} for n, (a, b, s) in sizes.items()],
    }


#: Edits of a case, one version each, below the next case's.
STEPS = 1 << 24


def chains(scripts: DataFrame, case_id: str) -> dict[str, DataFrame]:
    """version, edit, base of a corpus: a case is a chain from its base, a version an edit of its script. Versions of the i-th case (by id) begin at i * STEPS."""
    places = ranked(scripts.select(case_id), [], [case_id], "place")
    rows = scripts.join(places, case_id).withColumn("root_id", F.col("place") * F.lit(STEPS))
    steps = rows.select("root_id", F.posexplode("script").alias("k", "e")).withColumn("version_id", F.col("root_id") + F.col("k") + 1)
    version = rows.select(F.col("root_id").alias("version_id"), F.lit(None).cast("long").alias("parent_id"), "root_id").union(steps.select("version_id", F.col("version_id") - 1, "root_id"))
    return {
        "version": version, "edit": steps.select("version_id", "e.start", "e.delete_len", "e.insert"), "base": rows.select("root_id", F.col("base").alias("payload")),
        "child": rows.select(case_id, (F.col("root_id") + F.size("script")).alias("version_id")),
    }


def run_corpus(pairs: DataFrame, case_id: str = "case_id", average: int = 4096, magic: bytes = native.PACK_MAGIC, read_bytes: int = 4096, verify_samples: int = 16, leaf: int = 4096) -> dict:
    """pairs (case_id, base, child): sizes of all representations after the bases and after the children, a read of every child, and checks.

    Fails if a script does not rebuild its child, if a read differs between the
    representations, or if a sampled child does. lifetime_bytes counts the
    chunks of every state on the way, where a script has several edits.
    """
    scripts = stored(c.derived(pairs, case_id, magic=magic), "scripts")
    bad = c.unfaithful(scripts).select(case_id).first()
    if bad:
        raise ValueError(f"the script of case {bad[0]} does not rebuild its child")
    t = {k: stored(x, k) for k, x in chains(scripts, case_id).items()}
    every = stored(v.replayed(t["version"], t["edit"], t["base"], strict=True).select("version_id", "root_id", "state"), "states")
    piece, buffers = pieces.piece_tables(t["version"], t["edit"], t["base"])
    piece = pieces.cut(piece, leaf)
    manifest = stored(dedup.chunk_manifest(every, "version_id", "state", average), "manifest")
    cases = c.cases(scripts, case_id, read_bytes).join(t["child"], case_id)
    flat = every.join(cases.select("version_id", F.col("child_len").alias("len")), "version_id").select("version_id", "state", "len")
    sampled = verified(flat, piece.join(t["child"], "version_id", "left_semi"), buffers, manifest.join(t["child"], "version_id", "left_semi"), verify_samples, leaf) if flat.limit(1).count() else []
    plan = cases.select("version_id", "read_start", "read_len")
    reads = stored(pieces.read_ranges(plan, piece, buffers), "reads")
    direct = every.join(plan, "version_id").select("version_id", states.read_range("state", "read_start", "read_len").alias("direct"))
    differ = reads.join(direct, "version_id").where(~F.col("bytes").eqNullSafe(F.col("direct"))).count()
    if differ:
        raise ValueError(f"{differ} reads differ between representations")
    ends = t["child"].select("version_id").union(t["base"].select(F.col("root_id"))).distinct()
    one = lambda df: int(df.first()[0])
    summed = lambda df, col: one(df.agg(F.coalesce(F.sum(col), F.lit(0))))
    chunked = lambda df: one(dedup.chunk_stats(df).select(F.col("payload_bytes") + F.col("metadata_bytes")))
    bases = summed(t["base"], F.octet_length("payload"))
    children = summed(flat, "len")
    only = manifest.join(ends, "version_id", "left_semi")
    sizes = {
        FLAT: (bases, bases + children, summed(every, F.octet_length("state"))),
        PIECES: (summed(dedup.interned(t["base"]), "len"), summed(buffers, "len"), summed(buffers, "len")),
        CHUNKS: (chunked(manifest.join(t["base"].select(F.col("root_id").alias("version_id")), "version_id", "left_semi")), chunked(only), chunked(manifest)),
    }
    n = scripts.count()
    return {
        "cases": n, "edit_hunks": summed(scripts, F.size("script")), "logical_bytes": bases + children, "read_checksum": f"{read_checksum(reads):016x}", "verified_versions": sampled,
        "reports": [{"name": k, "base_bytes": a, "final_bytes": b, "growth_per_case": max(0, b - a) / max(1, n), "lifetime_bytes": x} for k, (a, b, x) in sizes.items()],
    }


def summary(samples: DataFrame, value: str = "ns") -> DataFrame:
    """p50, p95, p99 of a run's samples."""
    return report.percentiles(samples, [], value)
