"""SentencePiece encoding and decoding with a batched numpy Viterbi.

A text is cut where no piece can reach across; each distinct word is segmented
once. Words of about one length advance together, the shorter ones filled up
behind their end: rolling hashes of all their substrings probe the sorted keys
of the pieces of that length, and for each end position the best sum of scores
over the lengths of the last piece, with the length as backpointer, is one
vectorised maximum. A word beyond ALONE characters (text without spaces) is
probed in the same way, window by window, and advances by itself over its hits.

What the model file says of normalisation holds: texts begin with the space
that most models put there, which decoding takes away again; a model that
changes characters gets its texts from the library's normaliser. A text's own
U+2581 stays what it is and is written as bytes, where the library takes it for
a space.

Scores: a unigram model's file holds log probabilities, which are used as they
are. A merge model's file holds ranks; its pieces get the log probability of
Zipf's law at their rank. A character without piece becomes its UTF-8 bytes.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

SPACE = "▁"
#: Stands for a text's own U+2581, which no piece may match.
FOREIGN = 0x110000
#: What a character without piece costs beyond the worst piece.
UNKNOWN_COST = 10.0
#: Words that a worker remembers and their characters at most, which bounds the bytes held; cells of a batch of words.
REMEMBERED, REMEMBERED_CHARS, BATCH_CELLS = 1 << 18, 64, 1 << 19
#: A word of more characters advances by itself, in windows of so many starts.
ALONE, WINDOW = 1024, 1 << 16
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary: piece texts (None for those that no text matches), scores, and byte pieces (byte by id)."""

    def __init__(self, pieces: list[str | None], scores: np.ndarray, bytes_of: dict[int, int], prefix: bool = False, normalize=None):
        self.prefix, self.normalize = prefix, normalize
        self.scores, self.byte_ids = scores, {b: i for i, b in bytes_of.items()}
        if len(self.byte_ids) < 256:
            raise ValueError("the vocabulary has no piece for some byte")
        self.raw = [bytes([bytes_of[i]]) if i in bytes_of else (p or "").replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        usable = {i: p for i, p in enumerate(pieces) if p}
        self.longest = max(map(len, usable.values()), default=1)
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, self.longest + 1):
            ids = [i for i, p in usable.items() if len(p) == n]
            if ids:
                points = np.array([list(map(ord, usable[i])) for i in ids], np.uint64)
                h = np.zeros(len(ids), np.uint64)
                for k in range(n):
                    h = h * FACTOR + points[:, k]
                order = np.argsort(h, kind="stable")
                self.keys[n] = h[order], np.array(ids)[order]
        used = np.array([scores[i] for i in usable]) if usable else np.zeros(1)
        self.unknown = float(used.min()) - UNKNOWN_COST
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in usable.values())
        inner = {c for p in usable.values() if len(p) > 1 for c in p}
        alone = "".join(c for c in "\t\n\v\f\r" if c not in inner)
        self.cut = re.compile(r"(?s).+" if crossing else rf"[{alone}]| *[^ {alone}]+| +" if alone else " *[^ ]+| +")
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces, scores, bytes_of, ordinary = [], np.zeros(n), {}, []
        for i in range(n):
            piece = model.id_to_piece(i)
            pieces.append(None if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) else piece)
            scores[i] = model.get_score(i)
            if model.is_byte(i):
                bytes_of[i] = int(piece[3:5], 16)
            elif pieces[-1]:
                ordinary.append(i)
        ranks = scores[ordinary]
        if len(ranks) and (ranks[ranks > -1e8] == np.round(ranks[ranks > -1e8])).all():
            law = -np.log(np.arange(1, len(ordinary) + 1))
            scores[ordinary] = law - np.log(np.exp(law).sum())
        # What the normaliser does to each kind of character shows in a probe.
        probe = "a  b\u00e9\u0301\ufb01\uff21\t\u00a0\u200bB "
        got = model.normalize(probe)
        prefix = got.startswith(SPACE)
        same = got[prefix:] == probe.replace(" ", SPACE)
        return cls(pieces, scores, bytes_of, prefix and same, None if same else model.normalize)

    @staticmethod
    def _points(words: list[str], width: int) -> np.ndarray:
        """Code points by word and place, as pieces write them; FOREIGN behind a word's end."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        flat = np.where(flat == ord(SPACE), np.uint64(FOREIGN), np.where(flat == 0x20, np.uint64(ord(SPACE)), flat))
        out = np.full((len(words), width), FOREIGN, np.uint64)
        out[np.arange(width) < np.array([len(w) for w in words])[:, None]] = flat
        return out

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        lengths = np.array([len(w) for w in words])
        size = int(lengths.max())
        points = self._points(words, size)
        found, scores = {}, {}
        h = np.zeros((len(words), size + 1), np.uint64)
        for n in range(1, min(size, self.longest) + 1):
            h = h[:, : size - n + 1] * FACTOR + points[:, n - 1 :]
            if n not in self.keys:
                continue
            keys, ids = self.keys[n]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            found[n] = np.where(hit, ids[at], -1)
            scores[n] = np.where(hit, self.scores[ids[at]], self.unknown if n == 1 else -np.inf)
        if 1 not in found:
            found[1], scores[1] = np.full(points.shape, -1), np.full(points.shape, self.unknown)
        best = np.zeros((size + 1, len(words)))
        back = np.zeros((size + 1, len(words)), np.int32)
        for end in range(1, size + 1):
            top = best[end - 1] + scores[1][:, end - 1]
            last = np.ones(len(words), np.int32)
            for n in scores:
                if 1 < n <= end:
                    other = best[end - n] + scores[n][:, end - n]
                    better = other > top
                    top, last = np.where(better, other, top), np.where(better, np.int32(n), last)
            best[end], back[end] = top, last
        rows, end, columns = np.arange(len(words)), lengths.copy(), []
        while (end > 0).any():
            n = np.where(end > 0, back[end, rows], 0)
            ids = np.full(len(words), -2)
            for k in np.unique(n):
                if k:
                    mine = n == k
                    ids[mine] = found[int(k)][rows[mine], end[mine] - k]
            columns.append((ids, end - n))
            end = end - n
        steps = np.stack([c[0] for c in reversed(columns)], 1)
        starts = np.stack([c[1] for c in reversed(columns)], 1)
        if (steps != -1).all():
            return [row[row >= 0].tolist() for row in steps]
        return [self._spelled(zip(row, at, strict=True), word) for row, at, word in zip(steps.tolist(), starts.tolist(), words, strict=True)]

    def _spelled(self, steps, word: str) -> list[int]:
        """Ids of (id, start) steps; -1 is a character without piece, anything below is no step."""
        ids = []
        for i, k in steps:
            ids += [i] if i >= 0 else [self.byte_ids[b] for b in word[k].encode("utf-8", "surrogatepass")] if i == -1 else []
        return ids

    def segment_long(self, word: str) -> list[int]:
        """The same as segment([word]), in time and memory in proportion to the word."""
        size, reach = len(word), self.longest
        back, piece = array("i", bytes(4 * (size + 1))), array("i", bytes(4 * (size + 1)))
        carried = [0.0]
        for a in range(0, size, WINDOW):
            b = min(a + WINDOW, size)
            points = self._points([word[a : min(b + reach - 1, size)]], min(b + reach - 1, size) - a)[0]
            hits, h = [], np.zeros(len(points) + 1, np.uint64)
            for n in range(1, min(len(points), reach) + 1):
                h = h[: len(points) - n + 1] * FACTOR + points[n - 1 :]
                here = h[: b - a]
                found = np.full(len(here), -1)
                if n in self.keys:
                    keys, ids = self.keys[n]
                    at = np.minimum(np.searchsorted(keys, here), len(keys) - 1)
                    found = np.where(keys[at] == here, ids[at], -1)
                starts = np.arange(len(here)) if n == 1 else np.flatnonzero(found >= 0)
                hits.append((starts, np.full(len(starts), n), found[starts]))
            starts, lengths, ids = (np.concatenate(x) for x in zip(*hits, strict=True))
            order = np.argsort(starts, kind="stable")
            starts, lengths, ids = starts[order], lengths[order], ids[order]
            gain = np.where(ids >= 0, self.scores[ids], self.unknown)
            best = carried + [-np.inf] * (b - a + reach + 1 - len(carried))
            for start, n, i, x in zip(starts.tolist(), lengths.tolist(), ids.tolist(), gain.tolist(), strict=True):
                x += best[start]
                end = start + n
                if x >= best[end]:  # of equal sums the shortest last piece
                    best[end], back[a + end], piece[a + end] = x, n, i
            carried = best[b - a :]
        steps, end = [], size
        while end:
            steps.append((piece[end], end - back[end]))
            end -= back[end]
        return self._spelled(reversed(steps), word)

    def learn(self, words: set[str]) -> None:
        fresh = sorted(words.difference(self.known), key=len)
        at = 0
        while at < len(fresh) and len(fresh[at]) <= ALONE:
            # Words up to an eighth longer than the shortest go together.
            most = len(fresh[at]) + len(fresh[at]) // 8
            limit = at + max(1, BATCH_CELLS // (most * min(most, self.longest)))
            end = at + 1
            while end < min(len(fresh), limit) and len(fresh[end]) <= most:
                end += 1
            part = fresh[at:end]
            for w, ids in zip(part, self.segment(part), strict=True):
                self.known[w] = np.array(ids, "<u4").tobytes()
            at = end
        for w in fresh[at:]:
            self.known[w] = np.array(self.segment_long(w), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if self.normalize:
            texts = [self.normalize(t).replace(SPACE, " ") for t in texts]
        words = [self.cut.findall(f" {t}" if self.prefix and t else t) for t in texts]
        every = set().union(*words)
        self.learn(every)
        get = self.known.__getitem__
        out = [b"".join(map(get, each)) for each in words]
        for w in every:
            if len(w) > REMEMBERED_CHARS:
                del self.known[w]
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "surrogatepass")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(1)
def pieces(path: str) -> Pieces:
    """One for all tasks of a worker."""
    return Pieces.load(path)


def _encoded(path: str, with_ids: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for batch in batches:
            rest, text = batch.drop_columns(["__text"]), batch.column("__text")
            for first, raw in shingles.slices(text):
                texts = [t.decode() for t in raw]
                got = vocabulary.encode(texts)
                exact = [vocabulary.decode(g) == t for g, t in zip(got, texts, strict=True)]
                n = [len(g) // 4 for g in got]
                columns = [pa.array(n, pa.int64()), pa.array([zlib.crc32(g) for g in got], pa.int64()), pa.array(exact)]
                names = ["n_pieces", "ids_crc32", "round_trip"]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([*rest.slice(first, len(texts)).columns, *columns], [*rest.schema.names, *names])

    return encode


def encoded(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """The columns `keep` of docs with n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), round_trip (whether the ids decode to the text) and ids.

    A null text counts as empty and has no ids; all rows stay, repeated ones
    alike; texts of any length are encoded whole. Of equally good segmentations
    the one with the shortest last pieces is taken. The columns `keep` may not
    have the new ones' names; others of docs are not read. No rows give no rows.
    """
    common.modest_batches(docs.sparkSession)
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    more = [F.lit(0).cast("long").alias("n_pieces"), F.lit(0).cast("long").alias("ids_crc32"), F.lit(True).alias("round_trip")]
    more += [F.array().cast("array<int>").alias("ids")] if with_ids else []
    return rows.mapInArrow(_encoded(path, with_ids), rows.select(*keep, *more).schema)


def decoded(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with the text of their ids; null ids give an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for batch in batches:
            texts = [vocabulary.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(ids).to_pylist()]
            yield batch.drop_columns(["text"] if "text" in batch.schema.names else []).append_column("text", pa.array(texts, pa.string()))

    given = rows.drop("text")
    return given.mapInArrow(decode, given.select("*", F.lit("").alias("text")).schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded and decoded: number and checksum of its ids, and whether they give the text back."""
    return encoded(common.table(spark, sf_dir, "documents"), default_path(), with_ids=False)
