"""Mixing sources to target weights by proportionate-fair scheduling, with DataFrame functions alone.

The rows of a source are cut into blocks of equal size. Under an ideal fluid
schedule every source that still has rows advances in proportion to its
weight; block i may start in the slot in which the fluid schedule begins it
(its release time) and has to be out by the slot in which that ends it (its
deadline). Earliest deadline first over one slot a block meets all of them, so
that before and after every slot each source is less than one block away from
its share, also after others have run out.

The schedule is planned on the driver from the sources' row counts, over
MAX_BLOCKS blocks and a few at most whatever the number of rows: blocks grow
with the table. Rows are ranked within their source in hashed cells of about
CELL_ROWS, so no source, however large, meets in one task.

Beyond the SINGLE largest, sources without target weight are planned in two
levels, since the driver holds no list of all sources. Sources of about the same
size form a group, which has the sum of their weights; they begin and run out
together. Within a group row i of a source lies in the virtual time window
(i, i + 1) / weight, and the rows go by that time. Each source keeps its own
weight: it is about two rows away from its share at most, and a block has
LEAST_BLOCK_ROWS.
"""

from __future__ import annotations

import heapq
import json
import math
from bisect import bisect_right
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAX_BLOCKS, LEAST_BLOCK_ROWS, CELL_ROWS = 1 << 16, 16, 4096
#: Sources that are planned singly, largest first, besides those with a target weight; and groups of the others, by their size.
SINGLE, POOLS = 1024, 256
#: Weight of a source without target: its rows to this power.
POWER = 0.5
#: Target weights are rounded to so many parts of the largest one; smaller ones count as one part.
PARTS = 1 << 40


def windows(blocks: list[int], weights: list[int]) -> list[list[tuple[int, int]]]:
    """(release, deadline) of each block of each source, in slots."""
    ends = sorted({Fraction(n, w) for n, w in zip(blocks, weights, strict=True) if n})
    # Piecewise linear time: up to virtual time ends[j], slots pass at the joint weight of the sources not yet out.
    times, rates, at, t = [Fraction(0)], [], Fraction(0), Fraction(0)
    out_at: dict[Fraction, int] = {}
    for n, w in zip(blocks, weights, strict=True):
        out_at[Fraction(n, w)] = out_at.get(Fraction(n, w), 0) + (w if n else 0)
    left = sum(out_at.values())
    for end in ends:
        rates.append(left)
        left -= out_at[end]
        t += rates[-1] * (end - at)
        times.append(t)
        at = end
    starts = [Fraction(0), *ends[:-1]]

    def slot(v: Fraction) -> Fraction:
        j = max(0, bisect_right(starts, v) - 1)
        return times[j] + rates[j] * (v - starts[j])

    out = []
    for n, w in zip(blocks, weights, strict=True):
        points = [slot(Fraction(i, w)) for i in range(n + 1)] if n else []
        out.append([(p.__floor__(), q.__ceil__()) for p, q in zip(points, points[1:], strict=False)])
    return out


def schedule(blocks: list[int], weights: list[int]) -> list[list[int]]:
    """The slot of each block of each source."""
    spans, out = windows(blocks, weights), [[0] * n for n in blocks]
    waiting = sorted(((r, d, s, i) for s, each in enumerate(spans) for i, (r, d) in enumerate(each)), reverse=True)
    ready: list[tuple[int, int, int]] = []
    for t in range(sum(blocks)):
        while waiting and waiting[-1][0] <= t:
            _, d, s, i = waiting.pop()
            heapq.heappush(ready, (d, s, i))
        d, s, i = heapq.heappop(ready)
        assert d > t, "a deadline was missed"
        out[s][i] = t
    return out


def _source(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def grouped(sizes: list[int], most: int) -> list[int]:
    """Least size of each group of about equal sizes: every size by itself if that makes no more groups than `most`."""
    ratio = 1.0
    while True:
        firsts: list[int] = []
        for n in sorted(sizes):
            if not firsts or n > firsts[-1] * ratio:
                firsts.append(n)
        if len(firsts) <= most:
            return firsts
        ratio *= 1.01


def _ranked(docs: DataFrame, key: str) -> DataFrame:
    """docs (with __s, __h and cells, the number of cells of __s) with __r, the row's place in its __s by __h; without cells."""
    part = F.least(F.floor((F.col("__h").cast("double") / F.lit(2.0**64) + F.lit(0.5)) * F.col("cells")), F.col("cells") - 1)
    docs = docs.withColumn("__c", part.cast("long")).drop("cells")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__s").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = docs.groupBy("__s", "__c").agg(F.count("*").alias("n")).select("__s", "__c", before.alias("offset"))
    docs = docs.join(offsets, ["__s", "__c"])
    rank = F.row_number().over(Window.partitionBy("__s", "__c").orderBy("__h", key)) - 1 + F.col("offset")
    return docs.withColumn("__r", rank.cast("long")).drop("__c", "offset")


def _in_groups(docs: DataFrame, counts: DataFrame, firsts: list[int], lasts: list[int], key: str) -> DataFrame:
    """docs with __s, the group of their source, and __h, their time in it, from that of its begin to that of its end."""
    rows = F.col("__rows")
    sizes = counts.select("__s", F.col("rows").alias("__rows"), F.ceil(F.col("rows") / F.lit(CELL_ROWS)).alias("cells"))
    docs = _ranked(docs.join(sizes, "__s"), key)
    # Any number from 0 to 1 spreads the sources of a group over each window.
    within = F.pmod(F.xxhash64("__s", F.lit(1)), F.lit(1 << 20).cast("long")) / F.lit(float(1 << 20))
    group = F.size(F.filter(F.array(*[F.lit(n).cast("long") for n in firsts]), lambda n: n <= rows)) - 1
    last = F.element_at(F.array(*[F.lit(float(n)) for n in lasts]), group + 1)
    time = (F.col("__r") + within) / F.pow(rows, F.lit(POWER)) / F.pow(last, F.lit(1 - POWER))
    h = ((time - F.lit(0.5)) * F.lit(2.0**64)).cast("long")
    return docs.withColumn("__h", h).withColumn("__s", F.concat(F.lit("#"), group)).withColumnRenamed("__r", "__own").drop("__rows")


def planned(blocks: list[int], shares: list[float]) -> list[list[int]]:
    """The slot of each block: sources of weight 0 come after all others, and share among themselves alike."""
    out: list[list[int]] = [[] for _ in blocks]
    first = 0
    for now in ([i for i, x in enumerate(shares) if x > 0], [i for i, x in enumerate(shares) if x == 0]):
        top = max((shares[i] for i in now), default=0)
        whole = [max(1, round(shares[i] / top * PARTS)) if top else 1 for i in now]
        for i, slots in zip(now, schedule([blocks[i] for i in now], whole), strict=True):
            out[i] = [first + t for t in slots]
        first += sum(blocks[i] for i in now)
    return out


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", key: str = "doc_id", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """docs with mix_source, mix_block (within its source), mix_slot and mix_position (0 to rows - 1).

    weights: relative target weight by source (missing ones, null among them
    as a source of its own: rows ** POWER). A weight of 0 puts a source after
    all others; negative, infinite and NaN weights are an error. Columns of docs
    by the new names are replaced. Rows of a source come in the order
    of their key's hash. Beyond SINGLE sources those without target weight may
    be planned in groups, whose rows take turns by their sources' own weights;
    mix_slot is then the slot of the group's block. Repeated rows and rows
    without key are kept; no row is dropped or repeated: a source that runs out
    leaves its share to the others. No rows give no rows; texts are not read.
    """
    for name, x in (weights or {}).items():
        if not (math.isfinite(x) and x >= 0):
            raise ValueError(f"target weight of {name}: {x}")
    docs = docs.drop("mix_source", "mix_block", "mix_slot", "mix_position")
    spark, columns = docs.sparkSession, docs.columns
    h = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*columns))
    docs = docs.withColumn("__s", _source(source)).withColumn("__h", h).withColumn("__own", F.lit(None).cast("long"))
    given = {f"={k}": float(v) for k, v in (weights or {}).items()}
    counts = docs.groupBy("__s").agg(F.count("*").alias("rows"))
    top = counts.orderBy(F.desc("rows"), "__s").limit(SINGLE + 1).collect()
    found = {r["__s"]: (r["rows"], given.get(r["__s"], r["rows"] ** POWER)) for r in top[:SINGLE]}
    if len(top) > SINGLE:
        found |= {r["__s"]: (r["rows"], given[r["__s"]]) for r in counts.where(F.col("__s").isin(list(given))).collect()}
        known = F.broadcast(spark.createDataFrame([(x,) for x in found], "__s string"))
        others = counts.join(known, "__s", "left_anti")
        # One row a size: about the square root of twice the table's rows at most.
        sizes = sorted((r["rows"], r["n"]) for r in others.groupBy("rows").agg(F.count("*").alias("n")).collect())
        firsts = grouped([n for n, _ in sizes], POOLS)
        if firsts:
            members = [[(n, k) for n, k in sizes if a <= n < b] for a, b in zip(firsts, [*firsts[1:], float("inf")], strict=True)]
            found |= {f"#{i}": (sum(n * k for n, k in each), sum(n**POWER * k for n, k in each)) for i, each in enumerate(members)}
            apart = _in_groups(docs.drop("__own").join(known, "__s", "left_anti"), others, firsts, [each[-1][0] for each in members], key)
            docs = docs.join(known, "__s").unionByName(apart)
    names = sorted(found)
    rows = [found[s][0] for s in names]
    size = max(LEAST_BLOCK_ROWS, -(-sum(rows) // max_blocks))
    blocks = [-(-n // size) for n in rows]
    slots = planned(blocks, [float(found[s][1]) for s in names])
    sizes = sorted((slot, min(size, n - i * size), s, i) for s, (each, n) in enumerate(zip(slots, rows, strict=True)) for i, slot in enumerate(each))
    firsts, at = [[0] * n for n in blocks], 0
    for _, n, s, i in sizes:
        firsts[s][i] = at
        at += n
    plan = json.dumps([{"__s": s, "cells": -(-n // CELL_ROWS), "blocks": [{"slot": t, "first": f} for t, f in zip(a, b, strict=True)]} for s, n, a, b in zip(names, rows, slots, firsts, strict=True)])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(plan), "array<struct<__s:string, cells:int, blocks:array<struct<slot:long, first:long>>>>")))
    # One row a source, and one a block: both have a fixed bound.
    cells = F.broadcast(table.select("__s", "cells"))
    places = table.select("__s", F.posexplode("blocks").alias("block", "place")).select("__s", F.col("block").cast("long").alias("__b"), F.col("place.slot").alias("__slot"), F.col("place.first").alias("__first"))

    docs = _ranked(docs.join(cells, "__s"), key).withColumn("__b", F.expr(f"__r div {size}L"))
    docs = docs.join(F.broadcast(places), ["__s", "__b"])
    block = F.expr(f"coalesce(__own, __r) div {size}L")
    return docs.select(*columns, F.col(source).cast("string").alias("mix_source"), block.alias("mix_block"), F.col("__slot").alias("mix_slot"), (F.col("__first") + F.col("__r") % size).alias("mix_position"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mixture of sources."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixed(docs).select("doc_id", "source", "mix_block", "mix_slot", "mix_position")
