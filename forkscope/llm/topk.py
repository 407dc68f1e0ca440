"""Exact top-k inner-product search by a uniform threshold in three phases.

The components of the vectors are cut into segments; a segment's partial
products with a query are one score list. (1) Every cell of candidates gathers
the best entries of each of its lists and resolves their totals; the k-th best
total over all cells is a cutoff that no answer lies below. (2) A total of at
least the cutoff needs a partial score of at least cutoff / lists in some list
(the uniform threshold), so only such entries are collected, and dropped again
where the partial seen plus the bound of the lists still open stays below the
cutoff. (3) What is left is resolved exactly. A cell passes on its k best
entries at most, which lose no answer, whatever the number of ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of a cell's vectors, and of a block's queries, on average: the larger, the fewer times each is moved.
CELL_BYTES = 32 << 20
#: Groups of cells whose lists are merged first.
PARTS = 256
LISTS = 2
LONG = 2**63 - 1


def quantized(embedding, scale: float = 64.0):
    """floor(scale * x) of each component as double, whose whole numbers are exact."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))


def usable(embedding):
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return embedding.isNotNull() & ~bad


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of different lengths are filled up with zeros."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(rows), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = rows.flatten().to_numpy()
    return out


class Scores:
    """Partial and total scores of a cell, exact in double, or in Python's integers where double is too narrow."""

    def __init__(self, q: np.ndarray, v: np.ndarray):
        width = max(q.shape[1], v.shape[1], 1)
        q, v = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, v))
        bound = width * np.abs(q).max(initial=0) * np.abs(v).max(initial=0)
        if bound < 2**23:
            q, v = q.astype(np.float32), v.astype(np.float32)
        elif bound >= 2**53:
            q, v = (np.vectorize(int, otypes=[object])(m) for m in (q, v))
        cut = np.linspace(0, width, LISTS + 1).astype(int)
        self.partial = [q[:, a:b] @ v[:, a:b].T for a, b in zip(cut, cut[1:], strict=False) if a < b]

    def total(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return sum(p[rows, cols].astype(object if p.dtype == object else np.float64) for p in self.partial)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best entries of each row, in no order."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argsort(-scores, axis=1, kind="stable")[:, :k] if scores.dtype == object else np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]


def _long(x) -> int:
    return max(-LONG - 1, min(LONG, int(x)))


#: Scores of a list that are held at once.
SCORES = 1 << 21


def _strips(q: pa.Table, v: pa.Table):
    qid, vid, qs, vs = q["query_id"].to_numpy(), v["vec_id"].to_numpy(), _matrix(q["query"]), _matrix(v["vec"])
    strip = max(1, SCORES // max(1, len(vid)))
    for at in range(0, len(qid), strip):
        own = qid[at : at + strip]
        yield slice(at, at + strip), own, vid, Scores(qs[at : at + strip], vs), own[:, None] == vid


def _gather(k: int):
    def gather(q: pa.Table, v: pa.Table) -> pa.Table:
        ids, lists = [], []
        group = q["cell"][0].as_py() % PARTS if len(q) else 0
        if len(q) and len(v):
            for _, own, _, scores, same in _strips(q, v):
                seen = np.zeros(same.shape, bool)
                for p in scores.partial:
                    np.put_along_axis(seen, _best(p, k + 1), True, axis=1)
                seen &= ~same
                rows, cols = np.nonzero(seen)
                totals = scores.total(rows, cols)
                for i, part in enumerate(np.split(totals, np.cumsum(seen.sum(1))[:-1])):
                    ids.append(int(own[i]))
                    lists.append(sorted((_long(x) for x in part), reverse=True)[:k])
        return pa.table({"query_id": pa.array(ids, pa.int64()), "part": pa.array([group] * len(ids), pa.int64()), "best": pa.array(lists, pa.list_(pa.int64()))})

    return gather


def _collect(k: int):
    def collect(q: pa.Table, v: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(q) and len(v):
            cutoffs = q["cutoff"].to_numpy()
            for at, own, vid, scores, same in _strips(q, v):
                cut = cutoffs[at].astype(object if scores.partial[0].dtype == object else np.float64)[:, None]
                share = cut / len(scores.partial) if cut.dtype != object else cut // len(scores.partial)
                high = [p >= share for p in scores.partial]
                open_lists = sum(~h for h in high)
                known = sum(np.where(h, p, 0) for h, p in zip(high, scores.partial, strict=True))
                # Up to here only entries over the threshold are used; an open list adds its threshold at most.
                left = (open_lists < len(high)) & (known + open_lists * (share + (cut.dtype == object)) >= cut) & ~same
                rows, cols = np.nonzero(left)
                totals = scores.total(rows, cols)
                enough = np.asarray(totals >= cut[rows, 0], bool)
                rows, cols, totals = rows[enough], cols[enough], totals[enough]
                if totals.dtype == object:
                    totals = np.array([_long(x) for x in totals], object)
                order = np.lexsort((vid[cols], -totals, rows)) if totals.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -totals[i], vid[cols[i]])), int)
                rows, cols, totals = rows[order], cols[order], totals[order]
                first = np.searchsorted(rows, rows)
                keep = np.arange(len(rows)) - first < k
                out += zip(own[rows[keep]].tolist(), vid[cols[keep]].tolist(), map(_long, totals[keep]), strict=True)
        names = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(names.values())], names=list(names))

    return collect


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """The k best rows of vectors (vec_id, embedding; others are ignored) for each row whose vec_id is divisible by every.

    Returns query_id, rank from 1, vec_id, score; ties go to the smaller
    vec_id. Embeddings that are null or hold null, NaN or infinite components,
    and rows without vec_id, take no part; shorter ones count as filled up with
    zeros. Of repeated vec_ids the row with the smallest vector stays. Components
    and scores beyond a long are cut to its ends. No rows, or no queries, give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select("vec_id", quantized(F.col("embedding"), scale).alias("vec")).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    rows = common.stored(rows, "vectors")
    large = F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    n, n_queries, width, top = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("vec")), F.max(large)).first()
    # Whole numbers below 2**24 are exact in four bytes.
    kind, size = ("array<float>", 4) if (top or 0) < 1 << 24 else ("array<double>", 8)
    rows = rows.withColumn("vec", F.col("vec").cast(kind))
    held = max(1, CELL_BYTES // (size * max(1, width or 1)))
    cells = max(-(-n // held), min(64, -(-n // 128)), 1)
    blocks = max(-(-n_queries // held), 1)
    cell = F.pmod(F.xxhash64("vec_id"), F.lit(cells).cast("long"))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))
    candidates = rows.select("vec_id", "vec", cell.alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).groupBy("cell", "block")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query"), block.cast("int").alias("block"))

    def dealt(side: DataFrame):
        return side.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell")).groupBy("cell", "block")

    lists = dealt(queries).cogroup(candidates).applyInArrow(_gather(k), "query_id long, part long, best array<long>")
    # A list holds k totals at most. They are merged in two steps, so that no query gathers the lists of all cells at once.
    top = F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k).alias("best")
    merged = lists.groupBy("query_id", "part").agg(top).groupBy("query_id").agg(top)
    # Short of k known totals there is no cutoff yet: every entry may answer.
    cutoff = F.coalesce(F.get("best", F.lit(k - 1)), F.lit(-LONG - 1))
    cut = common.stored(merged.select("query_id", cutoff.alias("cutoff")), "cutoffs")
    found = dealt(queries.join(cut, "query_id")).cogroup(candidates).applyInArrow(_collect(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of embeddings for each vec_id divisible by 20."""
    return top_k(common.table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
