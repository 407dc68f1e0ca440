"""Version graphs: every version is its parent after one edit.

Tables: `version` (version_id, parent_id, root_id), `edit` (version_id, start,
delete_len, insert), keyed by the child so that siblings never mix, and `base`
(root_id, payload).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native, states
from ..storage import small_batches, stored


def ways(versions: DataFrame, edits: DataFrame | None = None, slices: bool = False) -> DataFrame:
    """version_id, root_id, top, depth, change, need, bad: the way of edits from the topmost version above each version.

    change: bytes by which the way lengthens a state; need: bytes that a state
    must have for all edits of the way to lie inside; bad: whether an edit on it
    has a null or negative part. With slices also the way itself: what it makes,
    as slices of the state it begins with and of inserts; numbers only, no bytes.

    Pointer doubling: after round r a way reaches 2**r versions up, so the
    deepest chain takes log2 of its length rounds, and a round composes two ways
    each. No version ever holds the list of its ancestors. Each round is stored,
    and only ways that have not reached their top go on.
    """
    own = [F.lit(0).cast("long").alias("change"), F.lit(0).cast("long").alias("need"), F.lit(False).alias("bad")]
    same = F.array(F.lit(native.ABOVE), F.lit(0).cast("long"), F.lit(native.REST))
    rows = versions.select("version_id", "root_id", F.col("parent_id").alias("up"))
    if edits is not None:
        start, gone, new = F.col("start").cast("long"), F.col("delete_len").cast("long"), F.octet_length("insert").cast("long")
        need = F.try_add(start, gone)
        bad = ~F.coalesce((start >= 0) & (gone >= 0) & need.isNotNull() & new.isNotNull(), F.lit(False))
        none = F.array().cast("array<bigint>")
        parts = F.concat(
            F.when(start > 0, F.array(F.lit(native.ABOVE), F.lit(0).cast("long"), start)).otherwise(none),
            F.when(new > 0, F.array(F.col("version_id").cast("long"), F.lit(0).cast("long"), new)).otherwise(none),
            F.array(F.lit(native.ABOVE), need, F.lit(native.REST)),
        )
        way = edits.select("version_id", (new - gone).alias("change"), need.alias("need"), bad.alias("bad"), F.when(bad, same).otherwise(parts).alias("slices"), F.lit(True).alias("there"))
        rows = rows.join(way if slices else way.drop("slices"), "version_id", "left")
        known = F.col("there") & F.col("up").isNotNull()
        own = [F.when(known & ~F.col("bad"), F.col(c)).otherwise(F.lit(0)).cast("long").alias(c) for c in ("change", "need")]
        own.append(F.coalesce(known & F.col("bad"), F.lit(False)).alias("bad"))
    path = [F.coalesce(F.when(known, F.col("slices")), same).alias("slices")] if slices and edits is not None else [same.alias("slices")] if slices else []
    depth = F.when(F.col("up").isNull(), F.lit(0)).otherwise(F.lit(1)).alias("depth")
    now = stored(rows.select("version_id", "root_id", "up", F.when(F.col("up").isNull(), F.col("version_id")).alias("top"), depth, *own, *path), "ways")
    done, going = now.where("up IS NULL"), now.where("up IS NOT NULL")
    names = ["top", "depth", "change", "need", "bad", *(["slices"] if slices else [])]
    while going.limit(1).count():
        above = done.unionByName(going).select(F.col("version_id").alias("up"), F.col("up").alias("next"), F.lit(True).alias("met"), *[F.col(c).alias(f"above_{c}") for c in names])
        both = going.drop("top").join(above, "up", "left").select(
            "version_id", "root_id", F.col("next").alias("up"), F.col("above_top").alias("top"), (F.col("depth") + F.coalesce("above_depth", F.lit(0))).alias("depth"),
            (F.col("change") + F.coalesce("above_change", F.lit(0))).alias("change"), F.greatest(F.coalesce("above_need", F.lit(0)), F.col("need") - F.coalesce("above_change", F.lit(0))).cast("long").alias("need"),
            (F.col("bad") | F.coalesce("above_bad", F.lit(False))).alias("bad"), *([F.coalesce("above_slices", same).alias("above_slices"), "slices"] if slices else []),
        )
        now = stored(both.mapInArrow(native.compose_columns, now.schema) if slices else both, "ways")
        done, going = done.unionByName(now.where("up IS NULL")), now.where("up IS NOT NULL")
    return done.drop("up")


def _fits(strict: bool) -> Column:
    """Whether all edits of a way (need, bad) lie inside the states they are applied to, from a base of base_len bytes; an error if strict."""
    good = ~F.col("bad") & (F.col("need") <= F.col("base_len"))
    return F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("edit/range out of bounds on the way to version "), F.col("version_id").cast("string"), F.lit(": len="), (F.col("base_len")).cast("string"), F.lit(" where the edits need "), F.col("need").cast("string"))).cast("boolean") if strict else F.lit(False))


def sliced(versions: DataFrame, edits: DataFrame, bases: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(heads, slices): version_id, root_id, depth, len, fits of each version, and what each is made of.

    slices: version_id, ordinal, ver_start, of_base, source, buf_start, len;
    the source is a root_id (of_base) or the version whose edit inserts the slice.
    A version with an edit out of bounds on its way does not fit and has none.
    """
    sized = bases.select("root_id", states.state_len("payload").alias("base_len"))
    rows = ways(versions, edits, slices=True).join(sized, "root_id").withColumn("fits", _fits(strict))
    heads = rows.select("version_id", "root_id", "depth", F.when(F.col("fits"), F.col("base_len") + F.col("change")).alias("len"), "fits")
    each = rows.where("fits").select(F.col("version_id").cast("long").alias("version_id"), F.col("root_id").cast("long").alias("root_id"), F.col("base_len").cast("long").alias("base_len"), "slices")
    return heads, each.mapInArrow(native.resolve_columns, "version_id long, ordinal int, ver_start long, of_base boolean, source long, buf_start long, len long")


def payloads(edits: DataFrame, bases: DataFrame) -> DataFrame:
    """of_base, source, payload: the bytes that slices name."""
    own = edits.select(F.lit(False).alias("of_base"), F.col("version_id").cast("long").alias("source"), F.col("insert").alias("payload"))
    return bases.select(F.lit(True).alias("of_base"), F.col("root_id").cast("long").alias("source"), "payload").union(own).where(F.octet_length("payload") > 0)


#: Bytes of the states that are put together from the same payloads in a task.
GROUP = 32 << 20


def replayed(versions: DataFrame, edits: DataFrame, bases: DataFrame, strict: bool = False) -> DataFrame:
    """version_id, root_id, depth, state: each version's bytes, put together from the slices that its way leaves. States come in the order of a walk down the tree."""
    made = met_in_groups(versions, edits, bases, strict).mapInArrow(native.assemble_columns, "version_id long, root_id long, depth int, state binary")
    return made.select(*[F.col(c).cast(versions.schema[c].dataType).alias(c) for c in ("version_id", "root_id")], "depth", "state")


def met_in_groups(versions: DataFrame, edits: DataFrame, bases: DataFrame, strict: bool = False) -> DataFrame:
    """Versions and the payloads that they are made of, group by group, for native.assemble_columns.

    Versions that share much are dealt to groups of about GROUP bytes of states,
    in the order of a walk down the tree. A group gets each payload that its
    versions use once, cut to what they use, however many versions use it: the
    shuffle is about as large as the payloads, not as the states. Bases go in
    compressed blocks of neighbours.
    """
    spark = versions.sparkSession
    small_batches(spark)
    blocks = stored(bases.select(F.spark_partition_id().alias("part"), F.col("root_id").cast("long").alias("root_id"), "payload").mapInArrow(native.block_columns, "block long, ids array<bigint>, sizes array<bigint>, data binary"), "blocks")
    sized = blocks.select("block", F.explode(F.arrays_zip("ids", "sizes")).alias("b")).select("block", F.col("b.ids").alias("root_id"), F.col("b.sizes").alias("base_len"))
    rows = ways(versions, edits, slices=True).join(sized, "root_id").withColumn("fits", _fits(strict))
    long = [F.col(c).cast("long").alias(c) for c in ("version_id", "block", "root_id", "base_len")]
    each = rows.select(long[0], F.col("depth").cast("int").alias("depth"), *long[1:], "fits", "slices").mapInArrow(native.place_columns, "version_id long, depth int, block long, root_id long, len long, path array<bigint>, fits boolean, slices array<bigint>")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(each, "paths").repartitionByRange(n, "path", "version_id").sortWithinPartitions("path", "version_id")
    dealt = dealt.select(F.spark_partition_id().alias("part"), "len", "version_id", "root_id", "depth", "block", F.when(F.col("fits"), F.col("slices")).alias("slices"))
    placed = stored(dealt.mapInArrow(native.group_columns(GROUP), "group long, at long, version_id long, root_id long, depth int, block long, slices array<bigint>"), "placed")
    needs = placed.select("group", "block", F.coalesce("slices", F.array().cast("array<bigint>")).alias("slices")).mapInArrow(native.need_columns, "group long, of_base boolean, source long, lo long, hi long")
    needs = needs.groupBy("group", "of_base", "source").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    none = lambda kind: F.lit(None).cast(kind)
    inserts = needs.where("NOT of_base").join(edits.select(F.col("version_id").cast("long").alias("source"), F.col("insert").alias("payload")), "source")
    inserts = inserts.select("group", F.lit(native.AN_INSERT).cast("long").alias("at"), F.col("source").alias("version_id"), none("long").alias("root_id"), none("int").alias("depth"), "lo", none("array<bigint>").alias("sizes"), none("array<bigint>").alias("slices"), F.substring("payload", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("payload"))
    whole = needs.where("of_base").select("group", F.col("source").alias("block")).join(blocks, "block")
    whole = whole.select("group", F.lit(native.A_BLOCK).cast("long").alias("at"), none("long").alias("version_id"), none("long").alias("root_id"), none("int").alias("depth"), none("long").alias("lo"), "sizes", F.col("ids").alias("slices"), F.col("data").alias("payload"))
    own = placed.select("group", "at", "version_id", "root_id", "depth", none("long").alias("lo"), none("array<bigint>").alias("sizes"), "slices", none("binary").alias("payload"))
    return own.unionByName(inserts).unionByName(whole).repartition(n, "group").sortWithinPartitions("group", "at")


def append_history(turns: DataFrame, key: str, order: str, payload: Column) -> DataFrame:
    """Each turn's state when turn t appends to turn t - 1: key, order, state. The linear special case of replay, without joins.

    A key's turns meet in one window; keys are conversations, which are short
    beside the table.
    """
    window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = turns.select(key, order, F.collect_list(payload).over(window).alias("parts"))
    return parts.select(key, order, F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x)).alias("state"))


def lengths(versions: DataFrame, edits: DataFrame, bases: DataFrame) -> DataFrame:
    """version_id, len of every version from the edits' sizes alone: no payload but the bases' is read. Null where an edit is out of bounds."""
    rows = ways(versions, edits).join(bases.select("root_id", states.state_len("payload").alias("base_len")), "root_id")
    return rows.select("version_id", F.when(_fits(False), F.col("base_len") + F.col("change")).cast("long").alias("len"))


def sample_indices(total: Column, samples: int) -> Column:
    """Evenly spaced indices with the first and the last: at least two, as far as there are."""
    count = F.least(F.lit(max(samples, 2)).cast("long"), total)
    at = lambda k: F.when(k + 1 == count, total - 1).otherwise(F.floor(k * (total - 1) / F.greatest(count - 1, F.lit(1))).cast("long"))
    return F.when(count < 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(count - 1, F.lit(0).cast("long"))), at))


def digests(table: DataFrame, key: str = "version_id", state: str = "state") -> DataFrame:
    return table.select(key, F.sha2(F.col(state), 256).alias("digest"), states.state_len(state).alias("len"))


def differing(left: DataFrame, right: DataFrame, key: str = "version_id") -> DataFrame:
    """Of two tables of digests() the rows that differ or that one side lacks."""
    a = left.select(key, F.col("digest").alias("left_digest"), F.col("len").alias("left_len"))
    b = right.select(key, F.col("digest").alias("right_digest"), F.col("len").alias("right_len"))
    return a.join(b, key, "full").where(~F.col("left_digest").eqNullSafe(F.col("right_digest")))


def mismatches(left: DataFrame, right: DataFrame, key: str = "version_id", state: str = "state") -> DataFrame:
    """Rows whose states differ or that one side lacks; none if two representations are equivalent. Digests are compared, not payloads shuffled."""
    return differing(digests(left, key, state), digests(right, key, state), key)
