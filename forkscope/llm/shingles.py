"""Word shingles of many texts at once, as 64-bit hashes, with numpy.

Hash equality stands for equality of shingles: among m distinct shingles two
collide with a probability of about m * m / 2**65, and of m * m / 2**57 where
a join keeps 56 bits of them beside their place in its order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once, about; a longer text is hashed by itself.
SLICE_BYTES, ROWS = 1 << 20, 128
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A random value of each byte, A-Z like a-z."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)
    values[0x41:0x5B] = values[0x61:0x7B]
    return values


VALUES = _byte_values()
TURNS = mixed(np.arange(500, 564, dtype=np.uint64) * BASE) | np.uint64(1)


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    back = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (BASE, back))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(21, n.bit_length()))


def _runs(texts: list[bytes], spaces: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bytes of all texts, first and last place of each word, where each text ends, and what hashes stretches of bytes."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = np.concatenate([[True], spaces[data]])
    turn = np.flatnonzero(space[1:] != space[:-1])
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUES[data] * up[: len(data)])])
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, int)
    return data, turn[::2], turn[1::2], ends, sums, down


def words(texts: list[bytes], spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many each text has. Words are runs between bytes of `spaces` (a line feed must be one); A-Z count as a-z."""
    _, first, last, ends, sums, down = _runs(texts, spaces)
    hashes = mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(first, ends), prepend=0)


def beginnings(texts: list[bytes], sizes: tuple[int, ...], spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first n characters of every word that is longer, for each n of sizes, and the number of the text that each is of."""
    data, first, last, ends, sums, down = _runs(texts, spaces)
    heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    at, owner = np.searchsorted(heads, first), np.searchsorted(ends, first, side="right")
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, int)]
    for n in sizes:
        stop = heads[np.minimum(at + n, len(heads) - 1)]
        longer = stop < last
        start = first[longer]
        # Other turns than whole words have, so that a word and the same beginning are two things.
        hashes.append(mixed(((sums[stop[longer]] - sums[start]) * down[start]) ^ TURNS[n]))
        owners.append(owner[longer])
    return np.concatenate(hashes), np.concatenate(owners)


def shingles(texts: list[bytes], size: int, weigh: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Hashes of all shingles of `size` words in text order, and how many each text has: the whole sequence is one where there are fewer words.

    With weigh, a table of small numbers by the first 22 bits of a word's hash,
    also the sum of each shingle's words' numbers.
    """
    hashes, counts = words(texts)
    n = len(hashes)
    weights = weigh[(hashes >> np.uint64(42)).astype(np.int64)] if weigh is not None else np.zeros(0, np.uint8)
    runs = np.zeros(max(0, n - size + 1), np.uint64)
    heavy = np.zeros(len(runs) if weigh is not None else 0, np.uint8)
    for k in range(size if len(runs) else 0):
        runs += hashes[k : n - size + 1 + k] * TURNS[k]
        if len(heavy):
            heavy += weights[k : n - size + 1 + k]
    starts = np.cumsum(counts) - counts
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ends = np.cumsum(many)
    at = np.repeat(starts - (ends - many), many) + np.arange(many.sum())
    full = np.repeat(counts >= size, many)
    out, sums = np.zeros(len(at), np.uint64), np.zeros(len(at) if weigh is not None else 0, np.uint8)
    out[full] = mixed(runs[at[full]])
    if len(sums):
        sums[full] = heavy[at[full]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = hashes[starts[i] : starts[i] + counts[i]]
        out[ends[i] - 1] = mixed((own * TURNS[: len(own)]).sum(dtype=np.uint64, keepdims=True) + TURNS[size + len(own)])[0]
        if len(sums):
            sums[ends[i] - 1] = weights[starts[i] : starts[i] + counts[i]].sum()
    return (out, many, sums) if weigh is not None else (out, many)


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


def sets(values: pa.Array, size: int, weigh: np.ndarray | None = None, place=None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct shingle hashes) of each text; place(hashes, sums) may turn the hashes of a slice into others."""
    for at, texts in slices(values):
        hashes, many, *sums = shingles(texts, size, weigh)
        if place:
            hashes = place(hashes, *sums)
        end = 0
        for i, m in enumerate(many.tolist()):
            own = np.sort(hashes[end : end + m])
            end += m
            yield at + i, own[np.concatenate([[True], own[1:] != own[:-1]])] if m > 1 else own
