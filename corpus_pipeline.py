"""From documents to token ids: language ID, quality, near duplicates, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of documents; the last one returns token ids. No stage
drops a row but those it decides against; rows without doc_id pass the
near-duplicate stage, which can't name them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forkscope.llm import common, langid, mixing, ngram_join, quality, sentencepiece

OWN = ("doc_id", "text", "lang", "source", "n_chars")


def apart(docs: DataFrame) -> DataFrame:
    """docs with its columns beyond OWN under names that no operator uses."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in OWN else f"__kept_{i}") for i, c in enumerate(docs.columns)])


def together(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, from rows made of apart(docs)."""
    return rows.select(*[F.col(c if c in OWN else f"__kept_{i}").alias(c) for i, c in enumerate(docs.columns)])


#: The near-duplicate stage links texts by five-word shingles at a Jaccard similarity of 80 % or more; op2_ngram_join has a rule of its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80

#: Its stages fit models, find components and plan schedules; SQL has no form of them.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined stay."""
    return together(langid.identified(apart(docs), host="source").where(langid.accepted()), docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likely to have the top grade stay."""
    return together(quality.scored(apart(docs), common.table(spark, sf_dir, "labels")).where(quality.selected()), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, once."""
    first = ngram_join.components_of(docs, NEAR_WORDS, NEAR_PERCENT).where("doc_id = component_id").select("doc_id").distinct()
    once = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    kept = apart(docs).join(first, "doc_id").withColumn("__once", once).where("__once = 1")
    return together(kept, docs).union(docs.where("doc_id IS NULL"))


def in_order(rows: DataFrame, position: Column, n: int) -> DataFrame:
    """n rows dealt out by their place from 0 to n - 1, which takes no sampling pass, and sorted by it."""
    parts = common.partitions(rows.sparkSession)
    part = F.floor(position * F.lit(parts).cast("long") / F.lit(max(1, n))).cast("int")
    return rows.repartitionById(parts, F.coalesce(part, F.lit(0))).sortWithinPartitions(position)


def file_places(docs: DataFrame) -> DataFrame:
    """docs with __place, the row's place in the files that docs is read from; null where docs isn't read from files."""
    try:
        meta = docs.metadataColumn("_metadata")
        rows = docs.select("*", meta["file_name"].alias("__file"), meta["row_index"].alias("__row"))
    except AnalysisException:
        return docs.withColumn("__place", F.lit(None).cast("long"))
    # One row a file: as many as the writer had tasks.
    number = F.regexp_extract("__file", r"part-(\d+)", 1).try_cast("long")
    sizes = rows.groupBy("__file").agg(F.max("__row").alias("last"))
    before = F.coalesce(F.sum(F.col("last") + 1).over(Window.orderBy(number, "__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("__file", before.alias("__first"))
    return rows.join(F.broadcast(firsts), "__file").withColumn("__place", (F.col("__first") + F.col("__row")).cast("long")).drop("__file", "__row", "__first")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of their place in the mixture."""
    return together(in_order(mixing.mixed(apart(docs)), F.col("mix_position"), docs.count()), docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in the order of the mixture, with mix_position and the check that they decode to its text."""
    rows = file_places(docs.select("doc_id", "text", "lang", "source")).withColumnRenamed("__place", "mix_position")
    rows = in_order(rows, F.col("mix_position"), docs.count())
    return sentencepiece.encoded(rows, sentencepiece.default_path(), keep=("doc_id", "lang", "source", "mix_position"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing_sources", mixing_sources),
    ("sentencepiece", sentencepiece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
