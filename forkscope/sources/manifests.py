"""Corpus manifests, snapshots and packs as tables, and the ways back to files."""

from __future__ import annotations

from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native
from ..storage import new_path


def parsed(lines: DataFrame, line: str = "value", number: str | None = None, root: str = "") -> DataFrame:
    """case_id, base_path, child_path of tab-separated lines; blank ones and comments are skipped, further columns ignored.

    Relative paths are resolved against root. A line with fewer than three
    columns fails the query with its number, if there is one.
    """
    text = F.rtrim(F.regexp_replace(line, r"\s+$", ""))
    rows = lines.withColumn("__t", text).where((F.col("__t") != "") & ~F.col("__t").startswith("#")).withColumn("__f", F.split("__t", "\t"))
    where = F.concat(F.lit("manifest line "), F.col(number).cast("string")) if number else F.lit("a manifest line")
    error = F.raise_error(F.concat(where, F.lit(" must contain case_id, base path and child path"))).cast("string")
    field = lambda i: F.when(F.size("__f") >= 3, F.get("__f", F.lit(i))).otherwise(error)
    path = lambda i: F.when(field(i).rlike("^(/|[a-z][a-z0-9+.-]*:)") | F.lit(not root), field(i)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), field(i)))
    return rows.select(field(0).alias("case_id"), path(1).alias("base_path"), path(2).alias("child_path"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest is one file, read as one row so that an error can name its line. Fails if it has no case."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "value")).select("value", (F.col("at") + 1).alias("number"))
    rows = parsed(lines, number="number", root=path.rsplit("/", 1)[0] if "/" in path else "")
    if not rows.limit(1).count():
        raise ValueError("the manifest has no case")
    return rows


#: Files that are listed and read at once.
LISTED = 10_000


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """case_id, base, child: the manifest's cases with the bytes of their files. The driver holds LISTED paths at most."""
    cases = read_manifest(spark, path)
    plain = lambda p: F.regexp_replace(p, "^file:/*", "/")
    wanted = (r[0] for r in cases.select(F.explode(F.array("base_path", "child_path"))).distinct().toLocalIterator())
    folder, first, files = None, list(islice(wanted, LISTED)), None
    read = lambda names: spark.read.format("binaryFile").load(names).select(plain("path").alias("path"), "content")
    for names in chain([first], iter(lambda: list(islice(wanted, LISTED)), [])):
        if len(names) < LISTED and folder is None:
            files = read(names)
            break
        folder = folder or new_path(spark, "files")
        files = read(names)
        files.write.mode("append").parquet(folder)
    files = spark.read.schema(files.schema).parquet(folder) if folder else files
    base = cases.withColumn("path", plain("base_path")).join(files, "path").select("case_id", F.col("content").alias("base"))
    child = cases.withColumn("path", plain("child_path")).join(files, "path").select("case_id", F.col("content").alias("child"))
    return base.join(child, "case_id")


def read_packs(spark: SparkSession, path: str, magic: bytes = native.PACK_MAGIC) -> DataFrame:
    """path and one row per entry of the pack files below path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("snapshot"), F.inline(native.pack_entries(magic)("content")))


def packs(entries: DataFrame, key: str, magic: bytes = native.PACK_MAGIC) -> DataFrame:
    """key, pack: one pack per key of its entries (kind, mode, path, content). A pack is one row: choose keys with a bounded number of entries."""
    each = F.struct(F.col("kind").cast("int").alias("kind"), F.col("mode").cast("long").alias("mode"), "path", "content")
    return entries.groupBy(key).agg(F.collect_list(each).alias("es")).select(key, native.packed(magic)("es").alias("pack"))


def manifest_lines(cases: DataFrame, columns: list[str]) -> DataFrame:
    """Text lines of a manifest: a comment that names the columns, then the cases."""
    head = cases.sparkSession.createDataFrame([("# " + "\t".join(columns),)], "value string")
    return head.union(cases.select(F.concat_ws("\t", *columns).alias("value")))


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below path; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def write_json(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)
