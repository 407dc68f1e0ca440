"""Token ids on disk as one wavelet matrix per shard.

A shard holds the ids of whole documents in ascending doc_id order. Its bit
planes, most significant first, are stably partitioned by the plane above, so
rank and select on the planes give access to any token, counts of an id in any
range and the places where it occurs without unpacking the sequence.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"FSWAVE01"
#: Bits of a plane for each entry of its rank directory.
STEP = 512
SHARD_TOKENS = 1 << 20
#: Bytes of text that are split and looked up at once; words that a task remembers, and their bytes at most.
SLICE_BYTES, REMEMBERED, REMEMBERED_BYTES = 4 << 20, 1 << 19, 64


class WaveletMatrix:
    """Static sequence of unsigned integers below 2**bits."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray]):
        self.n, self.zeros, self.planes = n, zeros, planes
        self._ranks: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        ids = np.asarray(ids)
        if len(ids) and (int(ids.max()) >> bits or int(ids.min()) < 0):
            raise ValueError(f"an id does not fit {bits} bits")
        seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes = [], []
        for shift in range(bits - 1, -1, -1):
            one = ((seq >> seq.dtype.type(shift)) & seq.dtype.type(1)).astype(bool)
            planes.append(np.packbits(one))
            low = np.compress(~one, seq)
            zeros.append(len(low))
            seq = np.concatenate([low, np.compress(one, seq)])
        return cls(len(ids), zeros, planes)

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [pack(p.tobytes()) for p in self.planes]
        head = MAGIC + struct.pack("<QI", self.n, len(parts))
        return head + b"".join(struct.pack("<QQ", z, len(p)) for z, p in zip(self.zeros, parts, strict=True)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        n, bits = struct.unpack_from("<QI", data, 8)
        heads = [struct.unpack_from("<QQ", data, 20 + 16 * k) for k in range(bits)]
        at, planes, unpack = 20 + 16 * bits, [], zstandard.ZstdDecompressor().decompress
        for _, size in heads:
            planes.append(np.frombuffer(unpack(data[at : at + size], max_output_size=(n + 7) // 8 or 1), np.uint8))
            at += size
        if at != len(data):
            raise ValueError("a wavelet shard has the wrong length")
        return cls(n, [z for z, _ in heads], planes)

    @classmethod
    def open(cls, path: str) -> WaveletMatrix:
        return cls.from_bytes(Path(path).read_bytes())

    def save(self, path: str) -> None:
        Path(path).write_bytes(self.to_bytes())

    def __len__(self) -> int:
        return self.n

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        if self._ranks[level] is None:
            each = np.bitwise_count(self.planes[level]).astype(np.int64)
            each = np.pad(each, (0, -len(each) % (STEP // 8))).reshape(-1, STEP // 8).sum(1)
            self._ranks[level] = np.concatenate([[0], np.cumsum(each)])
        block, plane = i // STEP, self.planes[level]
        ones = int(self._ranks[level][block]) + int(np.bitwise_count(plane[block * STEP // 8 : i >> 3]).sum(dtype=np.int64))
        return ones + ((int(plane[i >> 3]) >> (8 - (i & 7))).bit_count() if i & 7 else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    __getitem__ = access

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        bits = len(self.planes)
        if value < 0 or value >> bits:
            return 0, 0
        for level in range(bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """How often value occurs in [lo, hi)."""
        hi = self.n if hi is None else min(hi, self.n)
        lo, hi = self._range(value, max(0, min(lo, hi)), hi)
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence (from 0); -1 if there are fewer."""
        lo, hi = self._range(value, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        at, bits = lo + k, len(self.planes)
        for level in range(bits - 1, -1, -1):
            bit = value >> (bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, value: int) -> Iterator[int]:
        return (self.select(value, k) for k in range(self.count(value)))

    def decode(self) -> np.ndarray:
        """The whole sequence as unsigned 32-bit integers: the stable partitions are undone from the last plane up."""
        seq = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for shift, plane in enumerate(reversed(self.planes)):
            one = np.unpackbits(plane, count=self.n).astype(bool)
            zeros = self.n - int(np.count_nonzero(one))
            back = np.empty_like(seq)
            back[np.flatnonzero(~one)] = seq[:zeros]
            back[np.flatnonzero(one)] = seq[zeros:] | seq.dtype.type(1 << shift)
            seq = back
        return seq.astype("<u4")


#: The parts of a tokenizer file under which ASCII white space and the edges of letter runs always end a token.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: ASCII punctuation but the apostrophe, with which a token of its own may begin.
MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a printable byte of Latin-1 as itself, the n-th other one as character 256 + n."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(others)}


class Words(dict):
    """Ids of words, each encoded by the library when it first comes up."""

    def __init__(self, library):
        self.library, self.run = library, library.model.tokenize
        self.letters = _byte_letters()
        self.packed = [struct.pack("<I", i) for i in range(library.get_vocab_size())]

    def whole(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(got.ids, "<u4").tobytes() for got in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def __missing__(self, word: bytes) -> bytes:
        """A run of Latin letters is one token of the splitting pattern and goes straight to the library's merges; so is punctuation after it."""
        core = word.rstrip(MARKS)
        if core.isalpha():  # ASCII
            text = core.decode()
        else:
            text = core.decode().lower()
            if not text.isalpha() or max(text) >= "\u0250":
                return self.remembered(word, self.whole([word])[0])
            text = text.encode().decode("latin-1").translate(self.letters)
        got = self.get(core)
        if got is None:
            packed = self.packed
            got = self.remembered(core, b"".join([packed[t.id] for t in self.run(text)]))
        if len(core) < len(word):
            end = word[len(core) :]
            tail = self.get(end)
            if tail is None:
                tail = self.remembered(end, self.whole([end])[0])
            got = self.remembered(word, got + tail)
        return got

    def remembered(self, word: bytes, ids: bytes) -> bytes:
        """ids; long words are encoded anew each time, which bounds the bytes held."""
        if len(word) <= REMEMBERED_BYTES:
            self[word] = ids
        return ids


class Encoder:
    """encode(text) of the tokenizers library without special tokens.

    For a tokenizer that never joins characters across ASCII white space and
    ignores case, each distinct word is encoded by the library once and
    remembered; texts that may hold a special token, and all texts of other
    tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        rules = json.loads(self.library.to_str())
        pre = (rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.by_word = (rules["normalizer"] or {}).get("normalizers") == NORMALIZERS and len(pre) == 2 and pre[0].get("pattern") == {"Regex": SPLIT} and pre[1]["type"] == "ByteLevel" and all(t["content"].startswith("<|") for t in rules["added_tokens"])
        self.known = Words(self.library)
        self.whole = self.known.whole

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            return self.whole(texts)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        get = self.known.__getitem__
        return [self.whole([t])[0] if b"<|" in t else b"".join(map(get, t.lower().split())) for t in texts]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


#: Rows that are taken out of an Arrow batch at once.
ROWS = 128


def slices(values: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes, null as empty) in slices of about SLICE_BYTES."""
    at, size, held = 0, 0, []
    for first in range(0, len(values), ROWS):
        for v in values.slice(first, ROWS).cast(pa.large_binary()).to_pylist():
            held.append(v or b"")
            size += len(held[-1])
            if size >= SLICE_BYTES:
                yield at, held
                at, size, held = at + len(held), 0, []
    if held:
        yield at, held


SHARD = "part int, seq int, n_docs long, n_tokens long, doc_ids binary, lengths binary, payload binary"


def _packer(tokenizer: str, end_id: int, bits: int, shard_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        part, seq, ids, lengths, held, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def shard():
            wave = WaveletMatrix.build(np.frombuffer(b"".join(held), "<u4"), bits)
            row = [part, seq, len(ids), n, np.array(ids, "<i8").tobytes(), np.array(lengths, "<i8").tobytes(), wave.to_bytes()]
            names = ["part", "seq", "n_docs", "n_tokens", "doc_ids", "lengths", "payload"]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for at, texts in slices(batch.column("text")):
                for k, got in enumerate(encode(texts)):
                    got += end
                    if n and n + len(got) // 4 > shard_tokens:
                        yield shard()
                        seq, ids, lengths, held, n = seq + 1, [], [], [], 0
                    ids.append(docs[at + k])
                    lengths.append(len(got) // 4)
                    held.append(got)
                    n += len(got) // 4
        if ids:
            yield shard()

    return pack


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, vocabulary: int = 49_408, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes docs (doc_id, text; other columns are ignored) and writes one wavelet matrix per shard below path.

    A null text counts as empty and still gets its end id; rows without doc_id
    take no part. Repeated doc_ids are kept, ordered among themselves by their
    text's hash. Documents are never split over shards, however long: a shard
    of one document may be larger than the others. No rows give no shards. The container is
    Parquet, whose commit protocol leaves no half-written shard when an
    executor is lost; each row is one self-contained compressed shard.
    """
    spark = docs.sparkSession
    common.modest_batches(spark)
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(common.partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    bits = max(1, (max(vocabulary - 1, end_id)).bit_length())
    dealt.mapInArrow(_packer(tokenizer, end_id, bits, shard_tokens), SHARD).write.option("compression", "uncompressed").parquet(path)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, lengths = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["lengths"], "<i8")
            seq = memoryview(WaveletMatrix.from_bytes(row["payload"]).decode()).cast("B")
            ends = np.cumsum(lengths)
            sums = [zlib.crc32(seq[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            k = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * k, pa.int32()), pa.array([row["seq"]] * k, pa.int32()), pa.array(ids), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())],
                ["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards below path: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARD).parquet(path)
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the writer: few, whatever the number of documents.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0)).alias("local"))
    starts = starts.join(parts.select("part", before.alias("base")), "part").select("part", "seq", (F.col("base") + F.col("local")).alias("first"))
    each = shards.select("part", "seq", "doc_ids", "lengths", "payload").mapInArrow(_unpack, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return each.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents as token ids in wavelet shards, read back per document."""
    import public_tokenizers

    path = common.new_path(spark, "wavelet")
    write_shards(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(spark, path)
