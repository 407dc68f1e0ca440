"""Choosing and naming the inputs of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import ranked


def round_robin(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with turn (0, 1, ... within its group) and place: one row of each group in turn, groups by first appearance.

    A row's place is its rank by turn and its group's first appearance. Both
    ranks are taken by ranges, so neither a group nor a turn meets in one task.
    Pass the key columns only and join the rest back.
    """
    firsts = rows.groupBy(F.col(group).alias("__g")).agg(F.min(order).alias("__first"))
    turns = ranked(rows, [group], [order], "turn").join(firsts, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
    return ranked(turns, [], ["turn", "__first"], "place").drop("__first")


def selected(rows: DataFrame, selection: str, group: str, order: str, offset: int, limit: int) -> DataFrame:
    """limit rows from offset on, of the rows in order (sequential) or of the round robin."""
    if selection == "sequential":
        return rows.orderBy(order).offset(offset).limit(limit)
    if selection != "round-robin":
        raise ValueError(f"unknown selection {selection}")
    firsts = rows.groupBy(group).agg(F.min(order).alias("first"))
    return ranked(rows, [group], [order], "turn").join(firsts, group).orderBy("turn", "first").offset(offset).limit(limit).drop("turn", "first")


def by_path(entries: DataFrame, path: str, stage: str = "stage") -> DataFrame:
    """Entries in the order of their raw path bytes. One that is not at stage 0 fails the query."""
    conflict = F.raise_error(F.concat(F.lit("unmerged path "), F.col(path).cast("string")))
    checked = entries.withColumn(path, F.when(F.coalesce(F.col(stage), F.lit(0)) == 0, F.col(path).cast("binary")).otherwise(conflict.cast("binary"))) if stage in entries.columns else entries.withColumn(path, F.col(path).cast("binary"))
    return checked.orderBy(path)


def distinct_in_order(rows: DataFrame, value: str, order: str) -> DataFrame:
    return rows.groupBy(value).agg(F.min(order).alias("first")).orderBy("first")


def checked_count(rows: DataFrame, wanted: int) -> DataFrame:
    """rows, or an error if there are not as many as asked for."""
    found = rows.limit(wanted + 1).count()
    if found != wanted:
        raise ValueError(f"asked for {wanted} rows, found {'more' if found > wanted else found}")
    return rows
