"""Exact sharing of payloads: whole buffers, content-defined chunks, and what each representation retains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native
from ..functions.native import chunks_udf, together
from ..storage import stored
from .versions import GROUP, met_in_groups

#: Bytes of a chunk's and of a manifest entry's bookkeeping.
CHUNK_HEAD, REFERENCE = 16, 16


def interned(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per distinct non-empty payload: payload, copies, len. Grouping is exact: by length and SHA-256, then by the bytes of any one."""
    rows = payloads.where(F.octet_length(payload) > 0)
    return rows.groupBy(F.octet_length(payload).cast("long").alias("len"), F.sha2(F.col(payload), 256).alias("digest")).agg(F.count("*").alias("copies"), F.any_value(payload).alias(payload))


def leaves(states: DataFrame, key: str, payload: str, size: int) -> DataFrame:
    """key, ordinal, start, len, payload: fixed-size leaves of each state; an empty state has none."""
    n = F.octet_length(payload)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    rows = states.select(key, payload, F.posexplode(starts).alias("ordinal", "start"))
    return rows.select(key, "ordinal", F.col("start").cast("long").alias("start"), F.least(F.lit(size), F.octet_length(payload) - F.col("start")).cast("long").alias("len"), F.substring(payload, F.col("start") + 1, F.lit(size)).alias("payload"))


def chunk_manifest(states: DataFrame, key: str, payload: str, average: int = 4096) -> DataFrame:
    """key, ordinal, start, len, digest: the content-defined chunks of each state, whose digests name them.

    Every state is chunked by itself, in parallel. That equals repairing its
    parent's manifest after an edit for averages of 256 or more.
    """
    rows = states.select(key, payload, chunks_udf(average)(F.col(payload)).alias("chunks"))
    rows = rows.select(key, payload, F.posexplode("chunks").alias("ordinal", "c"))
    return rows.select(key, "ordinal", F.col("c.start").alias("start"), F.col("c.len").alias("len"), F.sha2(F.substring(payload, (F.col("c.start") + 1).cast("int"), F.col("c.len").cast("int")), 256).alias("digest"))


def chunk_pool(manifest: DataFrame) -> DataFrame:
    """One row per distinct chunk: digest, len, uses."""
    return manifest.groupBy("digest").agg(F.any_value("len").alias("len"), F.count("*").alias("uses"))


def chunk_store(manifest: DataFrame, states: DataFrame, key: str, payload: str) -> DataFrame:
    """digest, payload: the bytes of each distinct chunk, cut from one state that holds it."""
    one = manifest.groupBy("digest").agg(F.min(F.struct(key, "start", "len")).alias("at")).select("digest", "at.*")
    return one.join(states.select(key, payload), key).select("digest", F.substring(payload, (F.col("start") + 1).cast("int"), F.col("len").cast("int")).alias("payload"))


def rebuilt(manifest: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """key, state: the states of a manifest put together again from stored chunks; a state without chunks is not among them."""
    rows = manifest.join(store, "digest").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "payload"))), lambda c: c["payload"]).alias("parts"))
    return rows.select(key, together("parts").alias("state"))


def grouped_chunks(states: DataFrame, key: str, payload: str, average: int = 4096, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(manifest, chunks) of states that lie beside others that they share much with, as replayed() leaves them. Both are in one stored table.

    manifest: key, group, at, len, state_digest, chunks: each state as the numbers of its chunks in its group, of about `group` bytes of states.
    chunks: group, number, digest, payload: the distinct chunks of each group. Boundaries are those of chunk_manifest.
    """
    rows = states.select(F.spark_partition_id().cast("long").alias("part"), F.col(key).alias("key"), F.col(payload).alias("state"))
    return _of_groups(rows.mapInArrow(native.group_chunk_columns(average, group), _GROUPED.format(states.schema[key].dataType.simpleString())), key)


def replayed_chunks(versions: DataFrame, edits: DataFrame, bases: DataFrame, average: int = 4096, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """grouped_chunks() of the states of replayed(), chunked in the task that replays them: no state is stored or leaves it."""
    made = met_in_groups(versions, edits, bases).mapInArrow(native.assembled_chunk_columns(average, group), _GROUPED.format("long"))
    return _of_groups(made.withColumn("key", F.col("key").cast(versions.schema["version_id"].dataType)), "version_id")


_GROUPED = "key {}, group long, at long, len long, state_digest string, chunks array<int>, number int, digest binary, payload binary"


def _of_groups(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    rows = stored(rows, "chunks")
    manifest = rows.where("digest IS NULL").select(F.col("key").alias(key), "group", "at", "len", "state_digest", "chunks")
    return manifest, rows.where("digest IS NOT NULL").select("group", "number", "digest", "payload")


def grouped_store(chunks: DataFrame) -> DataFrame:
    """digest, payload, groups, numbers: the bytes of each distinct chunk once, and which number it has in which groups."""
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = chunks.select("digest", "group", "number", "payload").repartition(n, "digest").sortWithinPartitions("digest", "group")
    return rows.mapInArrow(native.once_columns, "digest binary, payload binary, groups array<bigint>, numbers array<int>")


def grouped_states(manifest: DataFrame, store: DataFrame, key: str, digests: bool = False) -> DataFrame:
    """key, state (or key, digest, len): the states of a manifest of groups put together again from stored chunks. A group gets each chunk once, however many of its states have it."""
    n, kind = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.schema[key].dataType.simpleString()
    sent = store.select("payload", F.explode(F.arrays_zip("groups", "numbers")).alias("u"))
    sent = sent.select(F.col("u.groups").alias("group"), F.lit(native.AN_INSERT).cast("long").alias("at"), F.col("u.numbers").alias("number"), "payload", F.lit(None).cast(kind).alias("key"), F.lit(None).cast("array<int>").alias("chunks"))
    own = manifest.select("group", "at", F.lit(None).cast("int").alias("number"), F.lit(None).cast("binary").alias("payload"), F.col(key).alias("key"), "chunks")
    met = sent.unionByName(own).repartition(n, "group").sortWithinPartitions("group", "at")
    return met.mapInArrow(native.join_chunk_columns(digests), f"key {kind}, " + ("digest string, len long" if digests else "state binary")).withColumnRenamed("key", key)


def chunk_at(manifest: DataFrame, key: str, offsets: DataFrame, offset: str) -> DataFrame:
    """offsets (key, offset) with the chunk that holds each."""
    return offsets.join(manifest, key).where((F.col("start") <= F.col(offset)) & (F.col(offset) < F.col("start") + F.col("len")))


def manifest_faults(manifest: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Keys whose chunks leave gaps or don't add up to the state's len (sizes: key, len)."""
    before = F.lag(F.col("start") + F.col("len"), 1, 0).over(Window.partitionBy(key).orderBy("ordinal"))
    sums = manifest.withColumn("gap", before != F.col("start")).groupBy(key).agg(F.count_if("gap").alias("gaps"), F.sum("len").alias("total"))
    rows = sizes.join(sums, key, "left").select(key, "len", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("total", F.lit(0)).alias("total"))
    return rows.where((F.col("gaps") > 0) | (F.col("total") != F.col("len")))


def chunk_stats(manifest: DataFrame) -> DataFrame:
    """One row: payload and metadata bytes that all manifests together retain, and their objects."""
    total = chunk_pool(manifest).agg(F.coalesce(F.sum("len"), F.lit(0)).alias("payload_bytes"), F.count("*").alias("chunks"), F.coalesce(F.sum("uses"), F.lit(0)).alias("references"))
    return total.select("payload_bytes", (F.col("chunks") * CHUNK_HEAD + F.col("references") * REFERENCE).alias("metadata_bytes"), "chunks", "references")


def growth(final: Column, initial: Column) -> Column:
    return F.greatest(F.lit(0), final - initial)


def per_branch(growth_bytes: Column, branches: Column) -> Column:
    return growth_bytes / F.greatest(F.lit(1), branches)
