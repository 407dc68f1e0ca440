"""Summaries and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running


def percentiles(df: DataFrame, by: list[str], value: str, points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """by and p<point> = sorted[floor((n - 1) * point / 100)], exact.

    Values are counted, running counts give the ranks, and the value that holds
    a wanted rank is taken. No group is gathered in a task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    places = running(counts, by, [value], "n", "__below")
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"t.{c}").eqNullSafe(F.col(f"p.{c}"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__all"))
    rows = places.alias("p").join(totals.alias("t"), same) if by else places.withColumn("__all", F.lit(totals.first()["__all"]))
    wanted = {p: F.floor((F.col("__all") - 1) * p / 100) for p in points}
    holds = lambda p: (F.col("__below") <= wanted[p]) & (wanted[p] < F.col("__below") + F.col("n"))
    keys = [F.col(f"p.{c}").alias(c) for c in by]
    return rows.groupBy(*keys).agg(*[F.max(F.when(holds(p), F.col(value))).alias(f"p{p}") for p in points])


def ratio(a: Column, b: Column, floor: float | None = None) -> Column:
    """a / b, null unless b > 0; with floor, b counts as that at least."""
    a, b = a.cast("double"), b.cast("double")
    return a / F.greatest(b, F.lit(float(floor))) if floor is not None else F.when(b > 0, a / b)


def compared(reports: DataFrame, name: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """reports (name, growth, edit_p95, read_p95): one row per pair with both sides and their ratios."""
    spark = reports.sparkSession
    wanted = spark.createDataFrame(pairs, "left_name string, right_name string")
    a = reports.select(F.col(name).alias("left_name"), *[F.col(c).alias(f"left_{c}") for c in ("growth", "edit_p95", "read_p95")])
    b = reports.select(F.col(name).alias("right_name"), *[F.col(c).alias(f"right_{c}") for c in ("growth", "edit_p95", "read_p95")])
    rows = wanted.join(a, "left_name").join(b, "right_name")
    return rows.withColumns({
        "growth_ratio": ratio(F.col("left_growth"), F.col("right_growth")),
        "edit_ratio": ratio(F.col("left_edit_p95"), F.col("right_edit_p95"), 1), "read_ratio": ratio(F.col("left_read_p95"), F.col("right_read_p95"), 1),
    })


def mib(n: Column) -> Column:
    return F.round(n / 1048576, 3)


def gib(n: Column) -> Column:
    return F.round(n / 1073741824, 3)


def micros(ns: Column) -> Column:
    return F.round(ns / 1000, 3)


def logical_bytes(sizes: DataFrame, size: str) -> DataFrame:
    return sizes.agg(F.coalesce(F.sum(F.col(size).cast("decimal(38,0)")), F.lit(0)).alias("logical_bytes"))
