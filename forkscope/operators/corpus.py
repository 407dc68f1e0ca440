"""Exact edit scripts between snapshot pairs, file by file where both are packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native, states


def entries(snapshots: DataFrame, key: str, payload: str, magic: bytes = native.PACK_MAGIC) -> DataFrame:
    """key and one row per pack entry (ordinal, kind, mode, path, start, end, content); snapshots that are no pack have none."""
    return snapshots.select(key, F.inline(native.pack_entries(magic)(F.col(payload))))


def merged(base: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Entries of both sides joined by key and path, with side: common, added or deleted."""
    a = base.select(key, "path", *[F.col(c).alias(f"base_{c}") for c in ("start", "end", "bytes")])
    b = child.select(key, "path", *[F.col(c).alias(f"child_{c}") for c in ("start", "end", "bytes")])
    rows = a.join(b, [key, "path"], "full")
    return rows.withColumn("side", F.when(F.col("base_start").isNull(), "added").when(F.col("child_start").isNull(), "deleted").otherwise("common"))


def run_edits(rows: DataFrame, key: str, first: int = native.ENTRIES_AT) -> DataFrame:
    """One edit per gap between common paths: key, start, delete_len, insert.

    Gaps and islands: a gap's number is how many common paths came before; it
    starts where the last common base entry ended, and replaces the base bytes
    of its deleted entries by the child's bytes of its added ones.
    """
    past = Window.partitionBy(key).orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    common = F.col("side") == "common"
    rows = rows.withColumn("gap", F.sum(common.cast("int")).over(past)).withColumn("at", F.coalesce(F.max(F.when(common, F.col("base_end"))).over(past), F.lit(first)))
    gap = rows.where(~common).groupBy(key, "gap").agg(
        F.min("at").cast("long").alias("start"),
        F.coalesce(F.sum(F.when(F.col("side") == "deleted", F.col("base_end") - F.col("base_start"))), F.lit(0)).cast("long").alias("delete_len"),
        F.aggregate(F.array_sort(F.collect_list(F.when(F.col("side") == "added", F.struct("path", F.col("child_bytes").alias("bytes"))))), F.lit(b""), lambda a, x: F.concat(a, x["bytes"])).alias("insert"),
    )
    return gap.select(key, "start", "delete_len", "insert")


def file_edits(rows: DataFrame, key: str) -> DataFrame:
    """One edit per common path whose bytes changed; equal ones are filtered before any is compared byte by byte."""
    changed = rows.where((F.col("side") == "common") & (F.col("base_bytes") != F.col("child_bytes")))
    return changed.select(key, native.local_diff("base_bytes", "child_bytes", "base_start").alias("e")).select(key, "e.*")


def ordered(edits: DataFrame, key: str) -> DataFrame:
    """key, script: edits from the highest offset down, at one offset replacements before pure insertions."""
    each = F.struct((-F.col("start")).alias("s"), (-F.col("delete_len")).alias("d"), F.struct(F.col("start").cast("long").alias("start"), F.col("delete_len").cast("long").alias("delete_len"), "insert").alias("e"))
    return edits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["e"]).alias("script"))


def derived(pairs: DataFrame, key: str, base: str = "base", child: str = "child", magic: bytes = native.PACK_MAGIC) -> DataFrame:
    """pairs with script: per file where both sides are packs, else one contiguous replacement; empty for equal snapshots."""
    sides = {}
    for side in (base, child):
        rows = entries(pairs, key, side, magic)
        sides[side] = rows.join(pairs.select(key, side), key).select(key, "path", "start", "end", F.substring(side, (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("bytes"))
    packs = entries_known(pairs, key, base, magic).join(entries_known(pairs, key, child, magic), key)
    rows = merged(sides[base], sides[child], key)
    m = len(magic)
    head = pairs.join(packs, key, "left_semi").select(key, native.local_diff(F.substring(base, m + 1, 8), F.substring(child, m + 1, 8), F.lit(m)).alias("e")).select(key, "e.*").where("start IS NOT NULL")
    by_file = run_edits(rows, key, m + 8).union(file_edits(rows, key)).union(head).join(packs, key, "left_semi")
    whole = pairs.join(packs, key, "left_anti").where(F.col(base) != F.col(child)).select(key, native.local_diff(base, child, F.lit(0)).alias("e")).select(key, "e.*")
    scripts = ordered(by_file.union(whole), key)
    return pairs.join(scripts, key, "left").withColumn("script", F.coalesce("script", F.array().cast(f"array<{states.EDIT}>")))


def entries_known(pairs: DataFrame, key: str, side: str, magic: bytes) -> DataFrame:
    return pairs.where(native.pack_entries(magic)(F.col(side)).isNotNull()).select(key)


def unfaithful(scripts: DataFrame, base: str = "base", child: str = "child") -> DataFrame:
    """Rows whose script does not turn base into child."""
    return scripts.where(~states.apply_script(base, "script").eqNullSafe(F.col(child)))


def cases(scripts: DataFrame, case_id: str, read_bytes: int = 4096, base: str = "base", child: str = "child") -> DataFrame:
    """scripts with child_len, hunks, read_len and read_start (the id's hash over the places where a read fits)."""
    size = states.state_len(child)
    rows = scripts.withColumns({"child_len": size, "hunks": F.size("script"), "read_len": F.least(F.lit(read_bytes).cast("long"), size)})
    return rows.withColumn("read_start", F.when(F.col("read_len") > 0, native.hash_modulo(F.col(case_id), F.col("child_len") - F.col("read_len") + 1)).otherwise(0))
