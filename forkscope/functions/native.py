"""Arrow UDFs for what SQL expressions can't hold: wrapping multiplication, byte comparison, chunk boundaries, packs, composed edits."""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F


def arrow(kind: str):
    """A pandas UDF that is made when it is first used in a query: workers import this module without a session."""

    def wrap(f):
        return lambda *columns: F.pandas_udf(f, kind)(*columns)

    return wrap


# Fixed values of public hash functions.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MASK = (1 << 64) - 1


def fnv1a(data: bytes, start: int = FNV_START) -> int:
    h = start
    for b in data:
        h = (h ^ b) * FNV_PRIME & MASK
    return h


def fnv1a_many(values: list[bytes]) -> np.ndarray:
    """All values at once, byte by byte; the few long ones that are left go on alone."""
    lengths = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat = np.frombuffer(b"".join(values), np.uint8).astype(np.uint64)
    starts = (np.cumsum(lengths) - lengths)[order]
    lengths, h = lengths[order], np.full(len(values), FNV_START, np.uint64)
    live, at = len(values), 0
    while True:
        live = int(np.searchsorted(-lengths[:live], -at, "left"))
        if live <= 16:
            break
        h[:live] = (h[:live] ^ flat[starts[:live] + at]) * np.uint64(FNV_PRIME)
        at += 1
    for i in range(live):
        h[i] = fnv1a(values[order[i]][at:], int(h[i]))
    out = np.empty(len(values), np.uint64)
    out[order] = h
    return out


@arrow("long")
def fnv1a_64(data: pd.Series) -> pd.Series:
    """FNV-1a of binary or string values as a signed 64-bit pattern; null for null."""
    there = data.notna()
    values = [v.encode() if isinstance(v, str) else bytes(v) for v in data[there]]
    out = pd.Series([None] * len(data), dtype="Int64", index=data.index)
    out[there] = fnv1a_many(values).view(np.int64)
    return out


@arrow("long")
def hash_modulo(data: pd.Series, size: pd.Series) -> pd.Series:
    """Unsigned FNV-1a modulo size, 0 for sizes below 1."""
    h = fnv1a_many([v.encode() if isinstance(v, str) else bytes(v) for v in data])
    n = size.to_numpy().astype(np.int64)
    return pd.Series(np.where(n > 0, h % np.maximum(n, 1).astype(np.uint64), 0).astype(np.int64))


def splitmix64(x: int) -> int:
    x = x + 0x9E3779B97F4A7C15 & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


#: Added to a byte before it is mixed into its gear; window of the rolling hash.
GEAR_OFFSET, WINDOW = 0x517CC1B727220A95, 64


@lru_cache(1)
def gears() -> np.ndarray:
    return np.array([splitmix64(b + GEAR_OFFSET) for b in range(256)], np.uint64)


class ChunkSizes:
    """Least and greatest chunk and the boundary mask of an average size."""

    def __init__(self, average: int):
        if average < 64:
            raise ValueError("the average chunk is 64 bytes at least")
        self.least, self.greatest = max(average // 4, 32), 4 * average
        self.mask = (1 << (average - 1).bit_length()) - 1


def candidates(data: bytes, mask: int) -> list[int]:
    """Places behind which a chunk may end, by the last WINDOW bytes before each.

    The rolling hash turns by one bit a byte and a byte leaves after 64 turns,
    so the hash is a function of the last 64 bytes: six doubling steps give it
    for all places at once.
    """
    n = len(data)
    h = gears()[np.frombuffer(data, np.uint8)]
    span = 1
    while span < WINDOW:
        turned = (h[:-span] << np.uint64(span)) | (h[:-span] >> np.uint64(64 - span)) if n > span else h[:0]
        h[span:] ^= turned
        span *= 2
    ends = np.flatnonzero((h & np.uint64(mask)) == 0) + 1
    return ends[ends >= WINDOW].tolist()


def chunk_ends(data: bytes, sizes: ChunkSizes) -> list[int]:
    """Ends of the content-defined chunks, picked from the candidates."""
    n = len(data)
    if not n:
        return []
    ends, out, start, k = candidates(data, sizes.mask), [], 0, 0
    while start < n:
        k = bisect_left(ends, start + sizes.least, k)
        natural = ends[k] if k < len(ends) else n + 1
        end = min(natural, start + sizes.greatest)
        if end > n:
            end = n
        out.append(end)
        start = end
    return out


class GroupChunks:
    """The distinct chunks of a group of states, numbered as they come.

    Where no chunk is shorter than the window, its end is a function of its own
    bytes, of none before and none behind: then a chunk that the group has is
    found by its first bytes and one comparison, and only what is new is hashed.
    """

    #: Bytes that are hashed at once where a chunk is new.
    AHEAD = 8192

    def __init__(self, sizes: ChunkSizes):
        self.sizes, self.chunks, self.numbers, self.by_head, self.tails = sizes, [], {}, {}, {}

    def number(self, chunk: bytes) -> int:
        found = self.numbers.setdefault(chunk, len(self.chunks))
        if found == len(self.chunks):
            self.chunks.append(chunk)
        return found

    def of(self, data: bytes) -> list[int]:
        """The numbers of a state's chunks, whose ends are those of chunk_ends()."""
        sizes, n, out, start = self.sizes, len(data), [], 0
        if sizes.least < WINDOW:
            ends = chunk_ends(data, sizes)
            return [self.number(data[a:b]) for a, b in zip([0, *ends], ends)]
        least, greatest, chunks, by_head = sizes.least, sizes.greatest, self.chunks, self.by_head
        ends, k, known = [], 0, 0  # candidates in data[:known], as far as they have been asked for
        while start < n:
            head = data[start : start + least]
            found = by_head.get(head)
            if found is not None and data.startswith(chunks[found], start):
                out.append(found)
                start += len(chunks[found])
                continue
            if n - start <= greatest and (found := self.tails.get(data[start:])) is not None:
                out.append(found)
                break
            if known < min(n, start + greatest):
                known = min(n, start + max(self.AHEAD, greatest))
                ends, k = [start + x for x in candidates(data[start:known], sizes.mask)], 0
            k = bisect_left(ends, start + least, k)
            end = min(ends[k] if k < len(ends) else n + 1, start + greatest)
            found = self.number(data[start : min(end, n)])
            if end <= n:
                by_head[head] = found
            else:
                self.tails[data[start:]] = found
            out.append(found)
            start = end
        return out


def chunks_udf(average: int):
    sizes = ChunkSizes(average)

    @arrow("array<struct<start:bigint, len:bigint>>")
    def chunks(data: pd.Series) -> pd.Series:
        def one(v):
            ends = chunk_ends(bytes(v), sizes) if v is not None else []
            return [{"start": a, "len": b - a} for a, b in zip([0, *ends], ends)]

        return data.map(one)

    return chunks


def common_ends(a: bytes, b: bytes) -> tuple[int, int]:
    """Length of the common prefix, and of the common suffix of what is left."""
    m = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    differ = np.flatnonzero(x[:m] != y[:m])
    prefix = int(differ[0]) if len(differ) else m
    m -= prefix
    differ = np.flatnonzero(x[len(a) - m :][::-1] != y[len(b) - m :][::-1])
    return prefix, int(differ[0]) if len(differ) else m


def local_edit(base: bytes, child: bytes, offset: int = 0) -> dict | None:
    """One replacement that turns base into child; None if they are equal."""
    if base == child:
        return None
    prefix, suffix = common_ends(base, child)
    return {"start": offset + prefix, "delete_len": len(base) - prefix - suffix, "insert": child[prefix : len(child) - suffix]}


@arrow("struct<start:bigint, delete_len:bigint, insert:binary>")
def local_diff(base: pd.Series, child: pd.Series, offset: pd.Series) -> pd.DataFrame:
    rows = [local_edit(bytes(a), bytes(b), int(o)) or {"start": None, "delete_len": None, "insert": None} for a, b, o in zip(base, child, offset)]
    return pd.DataFrame(rows, columns=["start", "delete_len", "insert"]).astype({"start": "Int64", "delete_len": "Int64"})


# The pack format: 19 bytes of magic, number of entries (u64), then per entry kind, mode, path length, content length, path, content.
# Packs of other writers differ in their magic alone, which is a parameter wherever packs are read or written.
PACK_MAGIC = b"FORKSCOPE_PACK_V1\0\0"
HEAD = struct.Struct("<BIIQ")
ENTRIES_AT = len(PACK_MAGIC) + 8
FILE, SYMLINK, GITLINK = 1, 2, 3


def write_pack(entries: list[tuple[int, int, bytes, bytes]], magic: bytes = PACK_MAGIC) -> bytes:
    """entries: (kind, mode, path, content), written in the order of their raw paths."""
    body = [HEAD.pack(k, m, len(p), len(c)) + p + c for k, m, p, c in sorted(entries, key=lambda e: e[2])]
    return magic + struct.pack("<Q", len(entries)) + b"".join(body)


def parse_pack(data: bytes, magic: bytes = PACK_MAGIC) -> list[dict] | None:
    """Entries with start and end, the head included; None for anything but a whole pack."""
    if not data.startswith(magic) or len(data) < ENTRIES_AT:
        return None
    (count,) = struct.unpack_from("<Q", data, len(magic))
    at, out = ENTRIES_AT, []
    while len(out) < count:
        if at + HEAD.size > len(data):
            return None
        kind, mode, n_path, n_content = HEAD.unpack_from(data, at)
        path_at = at + HEAD.size
        end = path_at + n_path + n_content
        if end > len(data):
            return None
        out.append({"ordinal": len(out), "kind": kind, "mode": mode, "path": data[path_at : path_at + n_path], "start": at, "end": end, "content": data[path_at + n_path : end]})
        at = end
    return out if at == len(data) else None


ENTRY = "ordinal:int, kind:int, mode:bigint, path:binary, start:bigint, end:bigint, content:binary"


def pack_entries(magic: bytes = PACK_MAGIC):
    @arrow(f"array<struct<{ENTRY}>>")
    def entries(data: pd.Series) -> pd.Series:
        return data.map(lambda v: parse_pack(bytes(v), magic) if v is not None else None)

    return entries


def packed(magic: bytes = PACK_MAGIC):
    """From an array of struct<kind, mode, path, content>."""

    @arrow("binary")
    def pack(entries: pd.Series) -> pd.Series:
        return entries.map(lambda es: write_pack([(int(e["kind"]), int(e["mode"]), bytes(e["path"]), bytes(e["content"])) for e in es], magic))

    return pack


@arrow("struct<start:bigint, delete_len:bigint, insert:binary>")
def decoded_edit(data: pd.Series) -> pd.DataFrame:
    """16 bytes of head (start, delete_len, little-endian), then the insert; null if it is shorter."""
    rows = []
    for v in data:
        if v is None or len(v) < 16:
            rows.append((None, None, None))
        else:
            start, delete_len = struct.unpack_from("<QQ", v)
            rows.append((start, delete_len, bytes(v[16:])))
    return pd.DataFrame(rows, columns=["start", "delete_len", "insert"]).astype({"start": "Int64", "delete_len": "Int64"})


@arrow("binary")
def encoded_edit(start: pd.Series, delete_len: pd.Series, insert: pd.Series) -> pd.Series:
    return pd.Series([struct.pack("<QQ", int(s), int(d)) + bytes(i) for s, d, i in zip(start, delete_len, insert)])


def zstd_size(level: int = 3):
    @arrow("long")
    def size(data: pd.Series) -> pd.Series:
        import zstandard

        pack = zstandard.ZstdCompressor(level=level).compress
        return data.map(lambda v: len(pack(bytes(v))) if v is not None else None).astype("Int64")

    return size


def delta_size(level: int = 19):
    """Size of a child compressed with its base as dictionary: a floor for delta storage."""

    @arrow("long")
    def size(base: pd.Series, child: pd.Series) -> pd.Series:
        import zstandard

        def one(a, b):
            words = zstandard.ZstdCompressionDict(bytes(a), dict_type=zstandard.DICT_TYPE_RAWCONTENT) if a else None
            return len(zstandard.ZstdCompressor(level=level, dict_data=words).compress(bytes(b)))

        return pd.Series([one(a, b) for a, b in zip(base, child)])

    return size


# -- composed edits: an edit, or a whole way of edits, as the list of slices that make up the result ---------------------------

#: Source of a slice of the state that a way begins with; any other source is the version whose edit inserts the slice. A list is flat: source, place, length, and so on.
ABOVE = -(1 << 63)
#: Source of a slice of a root's base payload.
BASE = ABOVE + 1
#: Length of a last slice that goes on to the end, whatever that is.
REST = 1 << 60


def composed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The slices (rows of source, place, length) of `then` after `first`: what it takes from above is looked up in first, all at once."""
    then = then[then[:, 2] > 0]
    ends = np.cumsum(first[:, 2])
    starts = ends - first[:, 2]
    whole = int(ends[-1]) if len(ends) else 0
    up = then[:, 0] == ABOVE
    lo = np.minimum(then[:, 1], whole)
    hi = np.where(then[:, 2] >= REST // 2, whole, np.minimum(lo + then[:, 2], whole))
    a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
    many = np.where(up, np.maximum(b - a, 0), 1)
    if not many.sum():
        return then[:0]
    own = np.repeat(np.arange(len(then)), many)
    k = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.where(up, a, 0), many)
    out = then[own]
    at = np.flatnonzero(up[own])
    k, own = k[at], own[at]
    low, high = np.maximum(lo[own], starts[k]), np.minimum(hi[own], ends[k])
    out[at, 0], out[at, 1], out[at, 2] = first[k, 0], first[k, 1] + low - starts[k], high - low
    out[out[:, 2] >= REST // 2, 2] = REST
    # Neighbours in one source are one slice again.
    new = np.ones(len(out), bool)
    new[1:] = (out[1:, 0] != out[:-1, 0]) | (out[1:, 1] != out[:-1, 1] + out[:-1, 2])
    head = np.flatnonzero(new)
    sizes = np.add.reduceat(out[:, 2], head)
    out = out[head]
    out[:, 2] = np.where(sizes >= REST // 2, REST, sizes)
    return out


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The slices of each row; a null list has none."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b].reshape(-1, 3) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slices of all rows one after another, and how many each row has."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(-1, 3), np.diff(offsets) // 3


def composed_rows(first: np.ndarray, firsts: np.ndarray, then: np.ndarray, thens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """composed() of many rows at once; firsts and thens: how many slices each row has. The slices of all rows, and how many each has."""
    rows = len(firsts)
    row, own_row = np.repeat(np.arange(rows), firsts), np.repeat(np.arange(rows), thens)
    keep, own_keep = first[:, 2] > 0, then[:, 2] > 0
    first, row, then, own_row = first[keep], row[keep], then[own_keep], own_row[own_keep]
    rest, up, to_end = first[:, 2] >= REST // 2, then[:, 0] == ABOVE, then[:, 2] >= REST // 2
    # A rest counts as so long that all that is asked for lies inside, so that the rows fit on one line.
    asked = np.where(up, then[:, 1], 0)
    long = int(asked.max(initial=0)) + int(np.where(up & ~to_end, then[:, 2], 0).max(initial=0)) + 1
    if long > 1 << 40 or int(first[~rest, 2].max(initial=0)) > 1 << 40 or len(first) > 1 << 20:
        at, own_at = np.cumsum(np.bincount(row, minlength=rows)), np.cumsum(np.bincount(own_row, minlength=rows))
        lists = [composed(x, y) for x, y in zip(np.split(first, at[:-1]), np.split(then, own_at[:-1]))]
        return np.concatenate([np.zeros((0, 3), np.int64), *lists]), np.array([len(x) for x in lists], np.int64)
    sizes = np.where(rest, long, first[:, 2])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    whole = np.zeros(rows, np.int64)
    np.add.at(whole, row, sizes)
    zero = (np.cumsum(whole) - whole)[own_row]
    lo = np.minimum(asked, whole[own_row])
    hi = zero + np.where(to_end, whole[own_row], np.minimum(lo + np.where(to_end, 0, then[:, 2]), whole[own_row]))
    lo = lo + zero
    a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
    many = np.where(up, np.maximum(b - a, 0), 1)
    own = np.repeat(np.arange(len(then)), many)
    if not len(own):
        return then[:0], np.zeros(rows, np.int64)
    k = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.where(up, a, 0), many)
    out, of = then[own], own_row[own]
    endless = ~up[own] & to_end[own]
    at = np.flatnonzero(up[own])
    k, own = k[at], own[at]
    low, high = np.maximum(lo[own], starts[k]), np.minimum(hi[own], ends[k])
    out[at, 0], out[at, 1], out[at, 2] = first[k, 0], first[k, 1] + low - starts[k], high - low
    endless[at] = to_end[own] & rest[k]
    new = np.ones(len(out), bool)
    new[1:] = (of[1:] != of[:-1]) | (out[1:, 0] != out[:-1, 0]) | (out[1:, 1] != out[:-1, 1] + out[:-1, 2])
    head = np.flatnonzero(new)
    out[endless, 2] = 0
    sums, endless = np.add.reduceat(out[:, 2], head), np.logical_or.reduceat(endless, head)
    out = out[head]
    out[:, 2] = np.where(endless, REST, sums)
    return out, np.bincount(of[head], minlength=rows)


def compose_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: the last two columns, the slices of the way above and of the own way, become one."""
    for batch in batches:
        rest = batch.columns[:-2]
        flat, many = composed_rows(*_flat(batch.column(batch.num_columns - 2)), *_flat(batch.column(batch.num_columns - 1)))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(3 * many)]).astype(np.int32)), pa.array(flat.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*rest, lists], [*batch.schema.names[:-2], "slices"])


def _whole(sizes: np.ndarray) -> np.ndarray:
    """A slice of the whole base for each row."""
    return np.stack([np.full(len(sizes), BASE), np.zeros(len(sizes), np.int64), sizes.astype(np.int64)], 1)


def resolve_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow, from version_id, root_id, base_len, slices: one row per slice of each version, the rest of the base cut to its length."""
    for batch in batches:
        versions, roots, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        flat, many = composed_rows(_whole(sizes), np.ones(len(sizes), np.int64), *_flat(batch.column(3)))
        ends = np.cumsum(flat[:, 2])
        firsts = np.cumsum(many) - many
        before = np.repeat(np.where(firsts > 0, np.concatenate([[0], ends])[firsts], 0), many)
        base = flat[:, 0] == BASE
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(versions, many)), pa.array((np.arange(len(flat)) - np.repeat(firsts, many)).astype(np.int32)), pa.array(ends - flat[:, 2] - before),
                pa.array(base), pa.array(np.where(base, np.repeat(roots, many), flat[:, 0])), pa.array(flat[:, 1]), pa.array(flat[:, 2]),
            ],
            ["version_id", "ordinal", "ver_start", "of_base", "source", "buf_start", "len"],
        )


# -- states put together in groups of neighbours ---------------------------------------------------------------------------------

#: Bytes of a block of bases, and of the states that go out in a batch; one state alone may have more.
BLOCK, OUT = 4 << 20, 4 << 20
#: Sources that name a version's place among its neighbours.
PLACED = 32
#: Place in the group of a block of bases and of an insert; states follow from 0 on.
A_BLOCK, AN_INSERT = -2, -1


def block_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow, from part, root_id, payload: neighbouring payloads compressed together. block, ids, sizes (null for a null payload), data."""
    part, count, ids, parts, size = 0, 0, [], [], 0

    def block():
        sizes = [None if x is None else len(x) for x in parts]
        data = pa.Codec("zstd", 3).compress(b"".join(x for x in parts if x is not None), asbytes=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([(part << 32) + count], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["block", "ids", "sizes", "data"]
        )

    for batch in batches:
        for part, key, value in zip(*(c.to_pylist() for c in batch.columns)):  # noqa: B020
            ids.append(key)
            parts.append(value)
            size += len(value or b"")
            if size >= BLOCK:
                yield block()
                count, ids, parts, size = count + 1, [], [], 0
    if ids:
        yield block()


def place_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow, from columns, then block, root_id, base_len, fits, slices: the columns and block, root_id, len, path, fits, slices.

    The slices are of the base and of inserts. path: block, root and the first sources by id. Parents mostly
    have lower ids than their children; then versions in the order of their paths follow each other as in a walk down the tree.
    """
    for batch in batches:
        blocks, roots, sizes, fits = (batch.column(i).to_pylist() for i in range(batch.num_columns - 5, batch.num_columns - 1))
        flat, many = _flat(batch.column(batch.num_columns - 1))
        good = np.array([bool(x) for x in fits], bool)
        flat, many = composed_rows(_whole(np.array([n or 0 for n in sizes], np.int64)), np.ones(len(fits), np.int64), flat[np.repeat(good, many)], np.where(good, many, 0))
        ends = np.cumsum(many)
        lists = np.split(flat, ends[:-1])
        paths = [[b, r, *np.unique(x[x[:, 0] != BASE, 0])[:PLACED].tolist()] for b, r, x in zip(blocks, roots, lists, strict=True)]
        lens = pa.array([int(x[:, 2].sum()) for x in lists], pa.int64())
        slices = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], 3 * ends]).astype(np.int32)), pa.array(flat.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], lens, pa.array(paths, pa.list_(pa.int64())), batch.column(batch.num_columns - 2), slices], [*batch.schema.names[:-3], "len", "path", "fits", "slices"])


def group_columns(size: int):
    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For mapInArrow, from part, len and other columns in the order of their places: group and at instead of part and len. A group has states of `size` bytes, and the one that goes beyond."""
        group = at = held = 0
        for batch in batches:
            groups, places = [], []
            for part, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held >= size:
                    group, held = group + 1, 0
                groups.append((part << 32) + group)
                places.append(at)
                at, held = at + 1, held + n
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(places, pa.int64()), *batch.columns[2:]], ["group", "at", *batch.schema.names[2:]])

    return columns


def need_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow, from group, block, slices: what each group needs of which source. group, of_base, source (a block if of_base), lo, hi."""
    for batch in batches:
        found: dict[tuple, list] = {}
        for group, block, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2))):
            for source, lo, n in x.tolist():
                if source == BASE:
                    found[group, True, block] = [0, 0]
                elif at := found.get((group, False, source)):
                    at[0], at[1] = min(at[0], lo), max(at[1], lo + n)
                else:
                    found[group, False, source] = [lo, lo + n]
        rows = [(*k, *v) for k, v in found.items()]
        names, kinds = ["group", "of_base", "source", "lo", "hi"], [pa.int64(), pa.bool_(), *[pa.int64()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def assemble_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow, from group, at, version_id, root_id, depth, lo, sizes, slices, payload, groups one after another and each in the order of `at`: version_id, root_id, depth, state."""
    group, bases, inserts, out, size = None, {}, {}, [], 0
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["version_id", "root_id", "depth", "state"])

    for batch in batches:
        names = batch.schema.names
        groups, places, ids, roots, depths, lows, sizes = (batch.column(names.index(c)).to_pylist() for c in ("group", "at", "version_id", "root_id", "depth", "lo", "sizes"))
        slices, payload = batch.column(names.index("slices")), batch.column(names.index("payload"))
        for i, at in enumerate(places):
            if groups[i] != group:
                group, bases, inserts = groups[i], {}, {}
            if at == A_BLOCK:
                data, place = memoryview(pa.Codec("zstd").decompress(payload[i].as_buffer(), sum(n or 0 for n in sizes[i]), asbytes=True)), 0
                for key, n in zip(slices[i].as_py(), sizes[i]):
                    bases[key] = data[place : place + (n or 0)]
                    place += n or 0
            elif at == AN_INSERT:
                inserts[ids[i]] = lows[i], memoryview(payload[i].as_buffer())
            else:
                state = None
                if slices[i].is_valid:
                    parts, flat = [], slices[i].as_py()
                    for source, place, n in zip(flat[::3], flat[1::3], flat[2::3]):
                        low, data = (0, bases[roots[i]]) if source == BASE else inserts[source]
                        parts.append(data[place - low : place - low + n])
                    state = b"".join(parts)
                out.append((ids[i], roots[i], depths[i], state))
                size += len(state or b"")
                if size >= OUT or len(out) >= 4096:
                    yield rows()
                    out, size = [], 0
    if out:
        yield rows()


# -- chunks and pieces in the same groups ----------------------------------------------------------------------------------------


def group_chunk_columns(average: int, group_bytes: int):
    sizes = ChunkSizes(average)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For mapInArrow, from part, key, state in the order of their places: key, group, at, len, state_digest, chunks of each state and number, digest, payload of each chunk that is new in its group.

        chunks: the numbers of a state's chunks in its group. A group has states of `group_bytes` bytes, and the one that goes beyond.
        """
        group = at = held = 0
        own = GroupChunks(sizes)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()]

        def rows(keys, *values):
            return pa.RecordBatch.from_arrays([keys, *[pa.array(v if v is not None else [None] * len(keys), k) for v, k in zip(values, kinds, strict=True)]], ["key", "group", "at", "len", "state_digest", "chunks", "number", "digest", "payload"])

        for batch in batches:
            groups, places, lens, sums, lists, new = [], [], [], [], [], []
            for part, state in zip(batch.column(0).to_pylist(), batch.column(2)):
                if held >= group_bytes:
                    group, held, own = group + 1, 0, GroupChunks(sizes)
                data, before = state.as_py(), len(own.chunks)
                groups.append((part << 32) + group)
                places.append(at)
                lens.append(None if data is None else len(data))
                sums.append(None if data is None else hashlib.sha256(data).hexdigest())
                lists.append(None if data is None else own.of(data))
                new += [(groups[-1], k, own.chunks[k]) for k in range(before, len(own.chunks))]
                at, held = at + 1, held + len(data or b"")
            yield rows(batch.column(1), groups, places, lens, sums, lists, None, None, None)
            if new:
                yield rows(pa.nulls(len(new), batch.column(1).type), [g for g, _, _ in new], None, None, None, None, [n for _, n, _ in new], [hashlib.sha256(c).digest() for _, _, c in new], [c for _, _, c in new])

    return columns


def assembled_chunk_columns(average: int, group_bytes: int):
    """For mapInArrow: group_chunk_columns() of what assemble_columns() makes, without a state leaving the task. The key is version_id."""
    chunked = group_chunk_columns(average, group_bytes)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made = assemble_columns(batches)
        return chunked(pa.RecordBatch.from_arrays([pa.array([part] * b.num_rows, pa.int64()), b.column(0), b.column(3)], ["part", "key", "state"]) for b in made)

    return columns


def once_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow, from digest, group, number, payload in the order of digests: each digest once, with one payload and the groups and numbers that it has there."""
    digest, payload, groups, numbers, out = None, None, [], [], []
    kinds = [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["digest", "payload", "groups", "numbers"])

    for batch in batches:
        for d, group, number, data in zip(*(c.to_pylist() for c in batch.columns)):
            if d != digest:
                if groups:
                    out.append((digest, payload, groups, numbers))
                digest, payload, groups, numbers = d, data, [], []
            groups.append(group)
            numbers.append(number)
        if len(out) >= 4096:
            yield rows()
            out = []
    if groups:
        out.append((digest, payload, groups, numbers))
        yield rows()


class Made:
    """States on their way out, or their digests alone: key and state, or key, digest and len."""

    def __init__(self, digests: bool):
        self.digests, self.keys, self.values, self.size = digests, [], [], 0

    def add(self, key, state: bytes | None) -> None:
        self.keys.append(key)
        self.values.append(state if not self.digests else (None, None) if state is None else (hashlib.sha256(state).hexdigest(), len(state)))
        self.size += 0 if self.digests else len(state or b"")

    def full(self) -> bool:
        return self.size >= OUT or len(self.keys) >= 4096

    def out(self, kind: pa.DataType) -> pa.RecordBatch:
        keys, values = self.keys, self.values
        self.keys, self.values, self.size = [], [], 0
        if self.digests:
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array([d for d, _ in values], pa.string()), pa.array([n for _, n in values], pa.int64())], ["key", "digest", "len"])
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(values, pa.binary())], ["key", "state"])


def join_chunk_columns(digests: bool = False):
    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For mapInArrow, from group, at, number, payload, key, chunks, groups one after another, in each the chunks (at is AN_INSERT) first: each state. One that lacks a chunk is null."""
        group, held, made = None, {}, Made(digests)
        for batch in batches:
            kind, payload, lists = batch.column(4).type, batch.column(3), batch.column(5)
            for i, (g, at, number, key) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)))):
                if g != group:
                    group, held = g, {}
                if at == AN_INSERT:
                    held[number] = payload[i].as_py()
                    continue
                state = None
                if lists[i].is_valid:
                    parts = [held.get(n) for n in lists[i].values.to_numpy().tolist()]
                    state = b"".join(parts) if None not in parts else None
                made.add(key, state)
                if made.full():
                    yield made.out(kind)
        if made.keys:
            yield made.out(kind)

    return columns


def join_piece_columns(digests: bool = False):
    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For mapInArrow, from group, at, ordinal, key, buffer_id, lo, len, payload, groups one after another: each version's state.

        In a group its buffers (at is AN_INSERT) come first, each from its byte lo on; then each version
        (ordinal is -1; with its len) and its pieces. A version that lacks a buffer, or has no piece where its len is not 0, is null.
        """
        group, held, made = None, {}, Made(digests)
        key = parts = empty = None
        whole = lambda: None if None in parts or not (parts or empty) else b"".join(parts)
        for batch in batches:
            kind, payload = batch.column(3).type, batch.column(7)
            for i, (g, at, ordinal, k, buffer, lo, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(7)))):
                if ordinal == -1 or at == AN_INSERT:
                    if parts is not None:
                        made.add(key, whole())
                        parts = None
                    if g != group:
                        group, held = g, {}
                    if made.full():
                        yield made.out(kind)
                if at == AN_INSERT:
                    held[buffer] = lo, memoryview(payload[i].as_buffer())
                elif ordinal == -1:
                    key, parts, empty = k, [], n == 0
                else:
                    low, data = held.get(buffer, (0, None))
                    parts.append(data if data is None else data[lo - low : lo - low + n])
        if parts is not None:
            made.add(key, whole())
        if made.keys:
            yield made.out(kind)

    return columns


@arrow("binary")
def together(parts: pd.Series) -> pd.Series:
    """An array of byte strings as one, in time in proportion to its size."""
    return parts.map(lambda v: b"".join(v) if v is not None else None)
