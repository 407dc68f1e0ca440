import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from forkscope.llm import common, wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 40), max_size=700))
def test_wavelet_matrix_answers_like_the_list(ids):
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(np.array(ids, np.int64), 6).to_bytes())
    assert w.decode().tolist() == ids and len(w) == len(ids)
    for i in range(0, len(ids), 37):
        assert w[i] == ids[i]
    for v in {*ids[:5], 41, 63}:
        at = [i for i, x in enumerate(ids) if x == v]
        assert w.count(v) == len(at) and list(w.occurrences(v)) == at
        assert w.count(v, 3, 200) == sum(3 <= i < 200 for i in at)
        assert w.select(v, len(at)) == -1


def test_shards_that_are_broken_are_refused():
    data = wavelet.WaveletMatrix.build(np.arange(100), 7).to_bytes()
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_bytes(b"x" + data)
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.from_bytes(data + b"x")
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.build(np.array([8]), 3)
    with pytest.raises(IndexError):
        wavelet.WaveletMatrix.from_bytes(data)[100]


TEXTS = ["Hello  wörld", None, "", "  ", "it's a b\u0085c \x1f d", "é é <|endoftext|>x", "ΑΣ Σ", "x" * 3000, "1234 don't\n\tI'LL", "漢字 ok", "word " * 5000, "ÉCOLE, İstanbul. ǅ ª. ß, a.b ., x., e\u0301. ŉ Ɐ, ﬁ. <|EndOfText|> x", "don't. l'été, ñandú. I'm,", "the*** the, the the!! x'' ** a-b, a-b* 1, 1 ½, ½ é, e\u0301 e\u0301, the'll, the',"]


def test_shards_round_trip(spark, tmp_path):
    rows = [(7 * i % 11, t, "other") for i, t in enumerate(TEXTS)] + [(None, "no id", ""), (3, "twice", ""), (3, "twice", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    path = str(tmp_path / "shards")
    wavelet.write_shards(docs, path, PATH, shard_tokens=50)
    got = sorted(tuple(r) for r in wavelet.read_shards(spark, path).collect())
    library, want, start = Tokenizer.from_file(PATH), [], 0
    kept = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    found = {}
    for doc, text, _ in kept:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        found.setdefault(doc, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for doc in found:
        mine = [(n, c) for d, _, n, c in got if d == doc]
        assert sorted(mine) == sorted(found[doc])
    for doc, at, n, _ in got:
        assert at == start
        start += n
    assert [g[0] for g in got] == [r[0] for r in kept]


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    wavelet.write_shards(docs, str(tmp_path / "none"), PATH)
    assert wavelet.read_shards(spark, str(tmp_path / "none")).collect() == []


def test_query_against_the_library(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").collect()
    library, start = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: tuple(r) for r in wavelet.op4_token_ids(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[d.doc_id] == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_words_like_whole_texts():
    encoder = wavelet.Encoder(PATH)
    assert encoder.by_word
    texts = [t.encode() for t in TEXTS if t is not None]
    assert encoder.encode(texts) == [encoder.whole([t])[0] for t in texts]
    other = wavelet.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word
    assert other.encode(texts) == [np.array(other.library.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_long_words_are_not_remembered():
    encoder = wavelet.Encoder(PATH)
    library = Tokenizer.from_file(PATH)
    words = [chr(97 + i) * 70 + str(i) for i in range(20)] + ["z" * 100_000, "short", "é" * 200, "x" * 80 + "..."]
    got = encoder.encode([" ".join(words).encode()])[0]
    assert np.frombuffer(got, "<u4").tolist() == library.encode(" ".join(words), add_special_tokens=False).ids
    assert max(map(len, encoder.known)) <= wavelet.REMEMBERED_BYTES
