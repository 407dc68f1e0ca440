"""Bottom-k document fingerprints, with DataFrame functions alone.

A fingerprint is the ascending list of the K smallest distinct hashes of a
text's five-word shingles (of the whole word sequence where there are fewer
words). Fingerprints merge by uniting and cutting to K; the K smallest of a
union are a uniform sample of its shingles, which gives resemblance,
containment and the number of distinct shingles. Texts with fewer than K
shingles are compared exactly.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 128
WORDS = 5
#: Rows of a block of consecutive documents, on average, and blocks at most (a block beyond that spills, it is never cut).
BLOCK_ROWS, BLOCKS = 2000, 8192
SPACE = r"[\x20\x09-\x0D]+"


def with_sketch(df: DataFrame, text: str, to: str, k: int = K, words: int = WORDS) -> DataFrame:
    """df with a column `to` of ascending distinct shingle hashes, k at most; a null or blank text has none.

    Words are lower-cased runs between ASCII white space. The steps are columns
    of their own, each computed once a row.
    """
    tokens, n = f"__{to}_words", F.size(f"__{to}_words")
    df = df.withColumn(tokens, F.transform(F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE), ""), lambda w: F.xxhash64(w)))
    shingles = F.when(n >= words, F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.xxhash64(F.slice(tokens, i, F.lit(words)))))
    shingles = shingles.when(n > 0, F.array(F.xxhash64(tokens))).otherwise(F.array().cast("array<long>"))
    return df.withColumn(to, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop(tokens)


def _smallest(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketches; two without shingles are alike, one without is unlike any other."""
    low = _smallest(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(low, a), b))
    return F.when(F.size(low) == 0, F.lit(1.0)).otherwise(both / F.size(low))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 where a has none."""
    union = distinct_shingles(_smallest(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def merged(df: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """One sketch per key for all its rows together. A task passes on k hashes of a key at most."""
    each = df.select(key, F.explode(sketch).alias("h")).distinct()
    low = each.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("r") <= k)
    some = low.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch))
    return df.select(key).distinct().join(some, key, "left").select(key, F.coalesce(sketch, F.array().cast("array<long>")).alias(sketch))


def as_text(sketch: Column) -> Column:
    """16 lower-case hexadecimal digits a hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _bounds(docs: DataFrame) -> list[int]:
    """doc_ids that start the blocks: the smallest one and approximate quantiles, which are ids of the table."""
    n, least = docs.agg(F.count("doc_id"), F.min("doc_id")).first()
    blocks = max(1, min(BLOCKS, n // BLOCK_ROWS))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 10 * BLOCKS)).first()[0] if blocks > 1 else []
    return sorted({least, *(cuts or [])}) if n else []


def with_next(docs: DataFrame, columns: list[str], more) -> DataFrame:
    """docs with next_<column> of the next row by doc_id, that of the first for the last.

    Rows are dealt out once, in blocks of consecutive ids; the first rows of a
    block are also sent to the block before. more(df) adds columns after that,
    which may be among columns. Rows of one doc_id are ordered by their text's hash.
    """
    bounds = _bounds(docs)
    starts = F.from_json(F.lit(json.dumps(bounds or [0])), "array<bigint>")
    # The last bound that is not above the id, by halving.
    steps = max(1, len(bounds).bit_length())

    def halve(lo_hi: Column, _: Column) -> Column:
        lo, hi = lo_hi["lo"], lo_hi["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        up = F.get(starts, mid) <= F.col("doc_id")
        return F.struct(F.when(up, mid).otherwise(lo).alias("lo"), F.when(up, hi).otherwise(mid).alias("hi"))

    span = F.struct(F.lit(0).alias("lo"), F.lit(max(1, len(bounds))).alias("hi"))
    block = F.aggregate(F.array_repeat(F.lit(0), steps), span, halve)["lo"]
    rows = docs.withColumn("__block", block)
    before = F.pmod(F.col("__block") - 1, F.lit(max(1, len(bounds))))
    own = F.struct(F.col("__block").alias("b"), F.lit(0).alias("t"))
    to = F.when(F.get(starts, F.col("__block")) == F.col("doc_id"), F.array(own, F.struct(before.alias("b"), F.lit(1).alias("t")))).otherwise(F.array(own))
    rows = rows.withColumn("__to", F.explode(to)).select(*docs.columns, F.col("__to.b").alias("__b"), F.col("__to.t").alias("__t"), F.xxhash64("text").alias("__h"))
    order = ["__b", "__t", "doc_id", "__h"]
    rows = more(rows.repartition(common.partitions(docs.sparkSession), "__b").sortWithinPartitions(*order))
    window = Window.partitionBy("__b").orderBy("__t", "doc_id", "__h")
    return rows.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns}).where("__t = 0").drop("__b", "__t", "__h")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text; others are ignored) its fingerprint and that of its edited text.

    The edited text has its last quarter replaced by the beginning of the next
    document's. A null text counts as empty; rows without doc_id take no part;
    repeated doc_ids are kept, next to each other. A single row is its own next.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(rows, ["text", "sketch"], lambda df: with_sketch(df, "text", "sketch"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), substring(next_text, 1, cast(n_chars div 4 as int)))")).drop("text", "next_text")
    rows = with_sketch(rows.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_sketch")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(common.table(spark, sf_dir, "documents"))
