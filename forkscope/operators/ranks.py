"""Row numbers and running sums without gathering a group, however large, in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def running(df: DataFrame, by: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """df with the sum of `amount` over the rows before it in its group `by`, in the order of `order`; without `by`, in the whole table.

    Rows are dealt out by ranges of (by, order) and summed within their range;
    a group's earlier ranges are added from a table of sums, one row per group
    and range. Pass the key columns only and join the rest back.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(ranges, *by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by] + [F.struct(*[F.col(c).isNull() for c in by]).cast("string")] if by else [F.lit("")]
    dealt = dealt.withColumn("__group", F.concat_ws("\u0001", *groups))
    sums = dealt.groupBy("__group", "__range").agg(F.sum(amount).alias("n"))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("n").over(past(Window.partitionBy("__group").orderBy("__range"))), F.lit(0))
    offsets = sums.select("__group", "__range", earlier.alias("__before"))
    own = F.coalesce(F.sum(amount).over(past(Window.partitionBy("__group", "__range").orderBy(*order))), F.lit(0))
    return dealt.join(offsets, ["__group", "__range"]).withColumn(name, (own + F.col("__before")).cast("long")).drop("__group", "__range", "__before")


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with each row's place (from 0) in its group."""
    return running(df.withColumn("__one", F.lit(1).cast("long")), by, order, "__one", name).drop("__one")
