"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a long, b long) but lone and smallest ones: component is the smallest node reached.

    The edges of a node are never gathered: minima are aggregated with partial
    sums on the map side and joined back. Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    now = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen, path = None, None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        path = common.new_path(spark, "edges")
        small.select("e.a", "e.b").where("a <> b").distinct().write.parquet(path)
        then, now = now, spark.read.schema(now.schema).parquet(path)
        print_of = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in then.inputFiles()[:1]:
            common.remove(spark, old.rsplit("/", 1)[0])
        if print_of == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = print_of
