"""Piece tables: a version as slices of shared immutable buffers, and reads that never build the whole state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native
from ..storage import stored
from . import versions as v


def piece_tables(versions: DataFrame, edits: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces, buffers).

    pieces: version_id, ordinal, ver_start, buffer_id, buf_start, len.
    buffers: buffer_id, len, payload; one per distinct payload, named by its SHA-256.

    A child's list is its parent's clipped to what comes before the edit, the
    insert, and the parent's clipped to what comes after. The lists are composed
    along the graph as numbers alone; payloads stay where they are. A version
    with an edit out of bounds on its way has no pieces.
    """
    _, slices = v.sliced(versions, edits, bases)
    named = v.payloads(edits, bases).withColumn("buffer_id", F.sha2("payload", 256))
    buffers = stored(named.groupBy("buffer_id").agg(F.any_value("payload").alias("payload")).select("buffer_id", F.octet_length("payload").cast("long").alias("len"), "payload"), "buffers")
    pieces = slices.join(named.drop("payload"), ["of_base", "source"]).select("version_id", "ordinal", "ver_start", "buffer_id", "buf_start", "len")
    return stored(pieces, "pieces"), buffers


def cut(pieces: DataFrame, leaf: int) -> DataFrame:
    """pieces in leaves of so many bytes at most."""
    if leaf < 1:
        raise ValueError("a leaf has one byte at least")
    rows = pieces.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1, F.lit(leaf).cast("long"))))
    size = F.least(F.lit(leaf).cast("long"), F.col("len") - F.col("part"))
    rows = rows.select("version_id", F.col("ordinal").alias("__o"), "part", (F.col("ver_start") + F.col("part")).alias("ver_start"), "buffer_id", (F.col("buf_start") + F.col("part")).alias("buf_start"), size.alias("len"))
    ordinal = (F.row_number().over(Window.partitionBy("version_id").orderBy("__o", "part")) - 1).cast("int")
    return rows.select("version_id", ordinal.alias("ordinal"), "ver_start", "buffer_id", "buf_start", "len")


def read_ranges(reads: DataFrame, pieces: DataFrame, buffers: DataFrame) -> DataFrame:
    """reads: version_id, read_start, read_len. Returns them with bytes, put together from the overlapping slices only."""
    hit = reads.join(pieces, "version_id").where((F.col("ver_start") < F.col("read_start") + F.col("read_len")) & (F.col("ver_start") + F.col("len") > F.col("read_start")))
    lo, hi = F.greatest("read_start", "ver_start"), F.least(F.col("read_start") + F.col("read_len"), F.col("ver_start") + F.col("len"))
    cut = hit.select("version_id", "read_start", "read_len", "ordinal", "buffer_id", (F.col("buf_start") + lo - F.col("ver_start") + 1).cast("int").alias("at"), (hi - lo).cast("int").alias("n"))
    slices = cut.join(buffers.select("buffer_id", "payload"), "buffer_id").select("version_id", "read_start", "read_len", F.struct("ordinal", F.substring("payload", F.col("at"), F.col("n")).alias("bytes")).alias("s"))
    parts = F.transform(F.array_sort(F.collect_list("s")), lambda s: s["bytes"])
    read = slices.groupBy("version_id", "read_start", "read_len").agg(parts.alias("parts")).select("version_id", "read_start", "read_len", native.together("parts").alias("bytes"))
    return reads.join(read, ["version_id", "read_start", "read_len"], "left").withColumn("bytes", F.coalesce("bytes", F.lit(b"")))


def whole(places: DataFrame, pieces: DataFrame, buffers: DataFrame, digests: bool = False) -> DataFrame:
    """version_id, state (or version_id, digest, len): versions read whole from their pieces. places: version_id, group, at, len.

    A group gets each buffer that its versions use once, cut to what they use, so
    that buffers move and not states. Groups are of versions that share much, as in grouped_chunks().
    """
    n, kind = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), places.schema["version_id"].dataType.simpleString()
    hit = pieces.join(places.select("version_id", "group", "at"), "version_id").select("group", "at", "ordinal", "buffer_id", F.col("buf_start").alias("lo"), "len")
    hit = stored(hit.repartition(n, "group").sortWithinPartitions("group", "at", "ordinal"), "placed-pieces")
    none = lambda kind: F.lit(None).cast(kind)
    needs = hit.groupBy("group", "buffer_id").agg(F.min("lo").alias("lo"), F.max(F.col("lo") + F.col("len")).alias("hi")).join(buffers.select("buffer_id", "payload"), "buffer_id")
    cut = F.substring("payload", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    needs = needs.select("group", F.lit(native.AN_INSERT).cast("long").alias("at"), F.lit(0).alias("ordinal"), none(kind).alias("key"), "buffer_id", "lo", (F.col("hi") - F.col("lo")).alias("len"), cut.alias("payload"))
    own = places.select("group", "at", F.lit(-1).alias("ordinal"), F.col("version_id").alias("key"), none("string").alias("buffer_id"), none("long").alias("lo"), "len", none("binary").alias("payload"))
    parts = hit.select("group", "at", "ordinal", none(kind).alias("key"), "buffer_id", "lo", "len", none("binary").alias("payload"))
    met = needs.unionByName(own).unionByName(parts).repartition(n, "group").sortWithinPartitions("group", "at", "ordinal")
    return met.mapInArrow(native.join_piece_columns(digests), f"key {kind}, " + ("digest string, len long" if digests else "state binary")).withColumnRenamed("key", "version_id")


def faults(pieces: DataFrame, buffers: DataFrame, leaf: int | None = None) -> DataFrame:
    """Pieces that break an invariant: gaps, empty or too long pieces, slices outside their buffer."""
    before = F.lag(F.col("ver_start") + F.col("len"), 1, 0).over(Window.partitionBy("version_id").orderBy("ordinal"))
    rows = pieces.withColumn("expected", before).join(buffers.select("buffer_id", F.col("len").alias("buffer_len")), "buffer_id", "left")
    bad = (F.col("expected") != F.col("ver_start")) | (F.col("len") <= 0) | F.col("buffer_len").isNull() | (F.col("buf_start") + F.col("len") > F.col("buffer_len"))
    return rows.where(bad | (F.col("len") > leaf) if leaf else bad)
