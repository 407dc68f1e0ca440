"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(threshold_j - score); the score is one weight per
hashed feature of the text, shared by all grades, and the thresholds ascend.
Features are the words, the beginnings of longer words (which stand for forms
of a word that no labelled text has), the runs of punctuation and a few shape
bands, each counted once a text. The model is fitted on the driver to a bounded sample of
labelled rows and applied to all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

#: Labelled rows that the model is fitted to at most, chosen by the hash of their id.
FITTED = 8192
BITS = 20
#: Lengths of word beginnings, in characters.
BEGINNINGS = (4, 6)
#: Rounds of the fit, and the strength of the pull of weights to zero.
ROUNDS, RIDGE = 400, 0.02
#: A document is selected where P(grade >= TOP) reaches LEAST_TAIL.
TOP, LEAST_TAIL = 2, 0.5

WORD_BREAKS = np.array([not (0x30 <= b < 0x3A or 0x41 <= b < 0x5B or 0x61 <= b < 0x7B or b >= 0x80) for b in range(256)])
MARK_BREAKS = np.array([not (0x21 <= b < 0x7F) for b in range(256)]) | ~WORD_BREAKS
KINDS = np.array([1 if 0x41 <= b < 0x5B else 2 if 0x61 <= b < 0x7B or b >= 0x80 else 3 if 0x30 <= b < 0x3A else 4 if b > 0x20 else 0 for b in range(256)], np.uint8)


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Ascending distinct feature numbers of each text."""
    words, n_words = shingles.words(texts, WORD_BREAKS)
    marks, n_marks = shingles.words(texts, MARK_BREAKS)
    place = np.uint64(64 - BITS)
    words, marks = (words >> place).astype(np.int64), (shingles.mixed(marks) >> place).astype(np.int64)
    begun, owner = shingles.beginnings(texts, BEGINNINGS, WORD_BREAKS)
    begun = np.unique(owner << BITS | (begun >> place).astype(np.int64))
    firsts = np.searchsorted(begun, np.arange(len(texts) + 1) << BITS)
    begun &= (1 << BITS) - 1
    out, w, m = [], 0, 0
    for i, text in enumerate(texts):
        a, b = int(n_words[i]), int(n_marks[i])
        own = np.unique(words[w : w + a])
        kinds = np.bincount(KINDS[np.frombuffer(text, np.uint8)], minlength=5)
        letters = max(1, kinds[1] + kinds[2])
        bands = [min(7, a.bit_length()), int(7.99 * kinds[1] / letters), int(7.99 * min(1, kinds[4] / letters)), int(7.99 * min(1, kinds[3] / letters)), int(7.99 * len(own) / a) if a else 0]
        shape = np.array([8 * k + x for k, x in enumerate(bands)], np.uint64)
        out.append(np.unique(np.concatenate([own, begun[firsts[i] : firsts[i + 1]], marks[m : m + b], (shingles.mixed(shape + np.uint64(12345)) >> place).astype(np.int64)])))
        w, m = w + a, m + b
    return out


class Ordinal:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    @classmethod
    def fitted(cls, rows: list[np.ndarray], grades: np.ndarray, size: int = 1 << BITS) -> Ordinal | None:
        """None where there are fewer than two grades. Adam on the mean log loss; thresholds are a first one and positive steps."""
        if len(np.unique(grades)) < 2:
            return None
        levels = int(grades.max())
        flat, lengths = np.concatenate(rows), np.array([len(r) for r in rows])
        seen, at = np.unique(flat, return_inverse=True)
        scale = 1 / np.sqrt(np.maximum(1, lengths.mean()))
        # A feature of fewer than three texts has no weight.
        often = np.bincount(at) >= 3
        kept, owner = often[at], np.repeat(np.arange(len(rows)), lengths)
        at, owner, seen = (np.cumsum(often) - 1)[at[kept]], owner[kept], seen[often]
        lengths = np.bincount(owner, minlength=len(rows))
        starts = np.cumsum(lengths) - lengths
        share = np.array([np.clip((grades <= j).mean(), 1e-3, 1 - 1e-3) for j in range(levels)])
        first = np.log(share / (1 - share))
        x = np.concatenate([np.zeros(len(seen)), [first[0]], np.log(np.maximum(1e-2, np.diff(first)))])
        mean, square, n = np.zeros_like(x), np.zeros_like(x), len(rows)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        for step in range(1, ROUNDS + 1):
            w, steps = x[: len(seen)], np.exp(x[len(seen) + 1 :])
            cuts = x[len(seen)] + np.concatenate([[0], np.cumsum(steps)])
            score = scale * np.add.reduceat(np.append(w[at], 0), np.minimum(starts, len(at)))
            score[lengths == 0] = 0
            up = np.where(grades < levels, sigmoid(cuts[np.minimum(grades, levels - 1)] - score), 1)
            low = np.where(grades > 0, sigmoid(cuts[np.maximum(grades, 1) - 1] - score), 0)
            p = np.maximum(up - low, 1e-9)
            d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
            d_score = (d_up - d_low) / n
            g = np.zeros_like(x)
            g[: len(seen)] = scale * np.bincount(at, d_score[owner], len(seen)) + RIDGE * w / n
            d_cuts = np.zeros(levels)
            np.add.at(d_cuts, np.minimum(grades, levels - 1), np.where(grades < levels, -d_up, 0) / n)
            np.add.at(d_cuts, np.maximum(grades, 1) - 1, np.where(grades > 0, d_low, 0) / n)
            g[len(seen)] = d_cuts.sum()
            g[len(seen) + 1 :] = [d_cuts[k + 1 :].sum() * s for k, s in enumerate(steps)]
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            x -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights = np.zeros(size)
        weights[seen] = x[: len(seen)] * scale
        return cls(weights, x[len(seen)] + np.concatenate([[0], np.cumsum(np.exp(x[len(seen) + 1 :]))]))

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each text."""
        score = np.array([self.weights[r].sum(dtype=np.float64) for r in rows])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -700, 700)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for _, texts in shingles.slices(batch.column("text")) for r in features(texts)]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "grade", "features"])


def grades(labels: DataFrame) -> DataFrame:
    """One grade a labelled document: 0 toxic, 1 poor, 2 good. Of repeated labels the lowest counts."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") < 1, 1).otherwise(2)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).cast("int").alias("grade"))


def sample(docs: DataFrame, graded: DataFrame, fitted: int = FITTED) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of labelled documents: `fitted` rows at most, one of each doc_id."""
    # Twice the ids wanted, by their hash; the exact choice is then made among few.
    graded = common.stored(graded, "grades")
    share = min(1.0, (2 * fitted + 100) / max(1, graded.count()))
    part = F.xxhash64("doc_id").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    chosen = graded.where(part <= share).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fitted)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # One text of each id, whatever the number of rows that repeat it: the one with the least hash.
    rows = rows.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = rows.select("doc_id", "text", "grade").mapInArrow(_featured, "doc_id long, grade int, features array<int>").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    lists = got["features"].combine_chunks() if len(got) else None
    return [lists[int(i)].values.to_numpy() for i in order], got["grade"].to_numpy()[order] if len(got) else np.zeros(0, int)


def _scored(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Ordinal | None = shared.value
        for batch in batches:
            rest = batch.drop_columns(["__text"])
            if model is None:
                expected = tail = pa.nulls(len(batch), pa.float64())
            else:
                tails = [model.tails(features(texts)) for _, texts in shingles.slices(batch.column("__text"))]
                tails = np.concatenate(tails) if tails else np.zeros((0, len(model.thresholds)))
                top = np.zeros(len(tails)) if tails.shape[1] < TOP else tails[:, TOP - 1]
                expected, tail = pa.array(tails.sum(1)), pa.array(top)
            yield pa.RecordBatch.from_arrays([*rest.columns, expected, tail], [*rest.schema.names, "expected_grade", "tail_probability"])

    return score


def scored(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs with expected_grade and tail_probability = P(grade >= TOP); columns of docs by these names are replaced.

    Both are null where the labelled documents hold fewer than two grades. A
    null text counts as empty; texts of any length are read whole. All rows
    stay, repeated ones alike; the fit takes one text of a repeated doc_id. An
    empty table gives no rows.
    """
    common.modest_batches(docs.sparkSession)
    model = Ordinal.fitted(*sample(docs.withColumn("text", F.col(text)), grades(labels)))
    given = docs.drop("expected_grade", "tail_probability")
    schema = given.select("*", F.lit(0.0).alias("expected_grade"), F.lit(0.0).alias("tail_probability")).schema
    for field in schema.fields[-2:]:
        field.nullable = True
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return given.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit(""))).mapInArrow(_scored(shared), schema)


def selected():
    return F.coalesce(F.col("tail_probability") >= LEAST_TAIL, F.lit(True))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, common.table(spark, sf_dir, "labels")).select("doc_id", "expected_grade", "tail_probability", selected().alias("selected"))
