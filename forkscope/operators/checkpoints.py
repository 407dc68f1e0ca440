"""Checkpoint layouts: every version in full, or a log of edits with a full state every few levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native, states
from ..storage import small_batches, stored, written
from . import versions as v


def full_checkpoints(replayed: DataFrame) -> DataFrame:
    return replayed.select("version_id", "state")


def delta_log(versions: DataFrame, edits: DataFrame, replayed: DataFrame, every: int = 16) -> tuple[DataFrame, DataFrame]:
    """(log, snapshots): one encoded edit per version, keyed by the version it makes, and full states at depths divisible by `every`."""
    log = versions.where("parent_id IS NOT NULL").select("version_id", "parent_id").join(edits, "version_id")
    log = log.select("version_id", "parent_id", native.encoded_edit("start", "delete_len", "insert").alias("edit"))
    return log, replayed.where(F.col("depth") % every == 0).select("version_id", "state")


def restored(versions: DataFrame, log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """version_id, state of all versions from the two tables alone: the nearest snapshot above, and the edits since.

    The snapshots are stored in blocks before this returns and not read after it.
    """
    kept = stored(snapshots.select("version_id", F.col("version_id").alias("kept")), "kept")
    # Cut the graph at the snapshots: each becomes a root of its own, so ways are short.
    cut = versions.join(kept, "version_id", "left")
    cut = cut.select("version_id", F.when(F.col("kept").isNull(), F.col("parent_id")).alias("parent_id"), F.lit(0).cast("long").alias("root_id"))
    graph = v.ways(cut).select("version_id", F.col("top").alias("root_id")).join(cut.drop("root_id"), "version_id")
    edits = log.select("version_id", native.decoded_edit("edit").alias("e")).select("version_id", "e.*")
    return v.replayed(graph, edits, snapshots.select(F.col("version_id").alias("root_id"), F.col("state").alias("payload"))).select("version_id", "state")


def reset_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP SCHEMA IF EXISTS `{name}` CASCADE")
    spark.sql(f"CREATE SCHEMA `{name}`")


def row_counts(spark: SparkSession, tables: list[str]) -> dict[str, int]:
    """0 for a table that does not exist."""
    return {t: spark.table(t).count() if spark.catalog.tableExists(t) else 0 for t in tables}


def relation_bytes(files: DataFrame, relations: DataFrame, names: list[str]) -> DataFrame:
    """files (relation_id, size) joined to relations (relation_id, name): one row, 0 if nothing matches."""
    rows = files.join(relations.where(F.col("name").isin(names)), "relation_id")
    return rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def outcome(mode: str, run) -> dict:
    """run() -> statistics. A failure is part of the result, not raised."""
    try:
        return {"mode": mode, "semantic_pass": True, "semantic_error": None, **run()}
    except Exception as e:  # any failure of a mode is its finding
        return {"mode": mode, "semantic_pass": False, "semantic_error": f"{type(e).__name__}: {e}"[:500]}


def reopened_mismatches(spark: SparkSession, path: str, replayed: DataFrame) -> DataFrame:
    """Writes states to path, reads them back in a new session and compares them with replayed."""
    written(replayed.select("version_id", "state"), path)
    fresh = spark.newSession()
    small_batches(fresh)
    return v.mismatches(fresh.read.parquet(path), replayed.select("version_id", "state"))


def sizes(full: DataFrame, log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: bytes of both layouts and the delta layout's share of the full one."""
    total = lambda df, c, n: df.agg(F.coalesce(F.sum(states.state_len(c)), F.lit(0)).alias(n)).withColumn("k", F.lit(0))
    rows = total(full, "state", "full_bytes").join(total(log, "edit", "log_bytes"), "k").join(total(snapshots, "state", "snapshot_bytes"), "k").drop("k")
    return rows.withColumn("delta_share", (F.col("log_bytes") + F.col("snapshot_bytes")) / F.greatest("full_bytes", F.lit(1)))
