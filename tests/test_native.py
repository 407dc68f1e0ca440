import random
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forkscope.functions import native


@given(st.lists(st.binary(max_size=30), max_size=40))
def test_fnv_many_like_one(values):
    assert native.fnv1a_many(values).tolist() == [native.fnv1a(v) for v in values]


def test_fnv_known_values():
    assert native.fnv1a(b"") == 0xCBF29CE484222325 and native.fnv1a(b"a") == 0xAF63DC4C8601EC8C and native.fnv1a(b"foobar") == 0x85944171F73967E8


def scalar_chunks(data, sizes):
    """The rolling form: one turn and one gear a byte, the byte 64 places back goes out."""
    gear, mask = [int(g) for g in native.gears()], (1 << 64) - 1
    h, start, ends = 0, 0, []
    for i, b in enumerate(data):
        h = ((h << 1 | h >> 63) & mask) ^ gear[b]
        if i >= 64:
            h ^= gear[data[i - 64]]
        n = i + 1 - start
        if n >= sizes.least and (i >= 63 and h & sizes.mask == 0 or n >= sizes.greatest):
            ends.append(i + 1)
            start = i + 1
    return ends + [len(data)] if start < len(data) else ends


@pytest.mark.parametrize("average", [64, 100, 256, 1024])
def test_chunks_like_a_rolling_scan(average):
    rng = random.Random(average)
    for n in (0, 1, 63, 64, 65, 500, 20_000):
        data = bytes(rng.randrange(4 if n == 500 else 256) for _ in range(n))
        assert native.chunk_ends(data, native.ChunkSizes(average)) == scalar_chunks(data, native.ChunkSizes(average))
    with pytest.raises(ValueError):
        native.ChunkSizes(63)


@pytest.mark.parametrize("average", [64, 256, 300, 1024])
def test_chunks_of_a_group_like_each_alone(average):
    rng, sizes = random.Random(average), native.ChunkSizes(average)
    for _ in range(10):
        states, group = [rng.randbytes(rng.choice([0, 300, 20_000]))], native.GroupChunks(sizes)
        for _ in range(12):
            p = rng.choice(states)
            at = rng.randint(0, len(p))
            states.append(p[:at] + rng.choice([rng.randbytes(rng.choice([0, 3, 9000])), b"." * rng.randint(0, 5000), p[:at]]) + p[at + rng.randint(0, 20) :])
        for data in [*states, *(x[: len(x) // 2] for x in states)]:
            ends = native.chunk_ends(data, sizes)
            assert [group.chunks[i] for i in group.of(data)] == [data[a:b] for a, b in zip([0, *ends], ends)]
        assert len(set(group.chunks)) == len(group.chunks)


def test_an_insert_shifts_few_chunks():
    rng = random.Random(5)
    data = rng.randbytes(1 << 20)
    child = data[:131_089] + b"nineteen bytes more" + data[131_089:]
    cut = lambda d: {d[a:b] for ends in [native.chunk_ends(d, native.ChunkSizes(4096))] for a, b in zip([0, *ends], ends)}
    assert sum(map(len, cut(child) - cut(data))) < 65_536


@given(st.binary(max_size=12), st.binary(max_size=12), st.integers(0, 5))
def test_local_edit(a, b, offset):
    e = native.local_edit(a, b, offset)
    if a == b:
        assert e is None
        return
    s = e["start"] - offset
    assert a[:s] + e["insert"] + a[s + e["delete_len"] :] == b
    assert s == len(a) or s == len(b) or a[s] != b[s]


@given(st.lists(st.tuples(st.sampled_from([1, 2, 3]), st.integers(0, 2**31), st.binary(max_size=6), st.binary(max_size=9)), max_size=5, unique_by=lambda e: e[2]), st.data())
def test_packs(entries, data):
    pack = native.write_pack(entries)
    got = native.parse_pack(pack)
    assert [(e["kind"], e["mode"], e["path"], e["content"]) for e in got] == sorted(entries, key=lambda e: e[2])
    assert [e["start"] for e in got] == [native.ENTRIES_AT, *[e["end"] for e in got]][: len(got)]
    assert native.parse_pack(pack + b"x") is None and native.parse_pack(pack[:-1]) is None
    assert native.parse_pack(pack, b"other magic") is None


def test_udfs_with_nulls(spark):
    df = spark.createDataFrame([(b"a", b"ab"), (None, b""), (b"", b"")], "x binary, y binary")
    assert [r[0] for r in df.select(native.fnv1a_64("x")).collect()] == [native.fnv1a(b"a") - (1 << 64), None, native.FNV_START - (1 << 64)]
    rows = df.where("x IS NOT NULL").select(native.local_diff("x", "y", F.lit(10)).alias("e")).collect()
    assert (rows[0].e.start, rows[0].e.delete_len, bytes(rows[0].e.insert)) == (11, 0, b"b") and rows[1].e.start is None
    codes = spark.createDataFrame([(struct.pack("<QQ", 3, 4) + b"xyz",), (b"short",), (None,)], "c binary")
    got = [r.e for r in codes.select(native.decoded_edit("c").alias("e")).collect()]
    assert (got[0].start, got[0].delete_len, bytes(got[0].insert)) == (3, 4, b"xyz") and got[1].start is None and got[2].start is None
    sizes = spark.createDataFrame([(b"z" * 1000, b"z" * 1000 + b"q")], "a binary, b binary").select(native.zstd_size()("b"), native.delta_size()("a", "b")).first()
    assert 0 < sizes[1] <= sizes[0] < 100
