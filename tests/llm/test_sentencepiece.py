import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from forkscope.llm import common, sentencepiece

PATH = sentencepiece.default_path()


@pytest.fixture(scope="module")
def real():
    return sentencepiece.Pieces.load(PATH)


def small(extra=()):
    pieces = [None] * 256 + ["▁", "a", "b", "▁a", "ab", "aab", "ba", "▁▁", "▁ab", *extra]
    scores = np.concatenate([np.zeros(256), -np.array([3, 2, 2.5, 3, 2.2, 4, 2.1, 5, 3.3, *[1.0] * len(extra)])])
    return sentencepiece.Pieces(pieces, scores, {i: i for i in range(256)})


def brute(vocabulary, pieces, text):
    """Scalar Viterbi over the whole text; the best score."""
    chars = [None if c == "▁" else "▁" if c == " " else c for c in text]
    best = [0.0] + [-np.inf] * len(chars)
    index = {p: i for i, p in enumerate(pieces) if p}
    for end in range(1, len(chars) + 1):
        for n in range(1, min(end, vocabulary.longest) + 1):
            part = chars[end - n : end]
            p = "".join(part) if None not in part else None
            s = vocabulary.scores[index[p]] if p in index else vocabulary.unknown if n == 1 else -np.inf
            best[end] = max(best[end], best[end - n] + s)
    return best[-1]


def score(vocabulary, ids, text):
    ids = np.frombuffer(ids, "<u4")
    plain = [i for i in ids if i >= 256]
    lost = sum(len(b) for b in [bytes(int(i) for i in ids if i < 256)])
    chars = bytes(int(i) for i in ids if i < 256).decode()
    assert lost == len(chars.encode())
    return sum(vocabulary.scores[i] for i in plain) + len(chars) * vocabulary.unknown


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab ▁\nxé😀"), max_size=14), st.booleans())
def test_against_scalar_viterbi(text, crossing):
    extra = ("b▁a",) if crossing else ()
    v = small(extra)
    pieces = [None] * 256 + ["▁", "a", "b", "▁a", "ab", "aab", "ba", "▁▁", "▁ab", *extra]
    [ids] = v.encode([text])
    assert v.decode(ids) == text
    assert score(v, ids, text) == pytest.approx(brute(v, pieces, text))


@settings(deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    v = sentencepiece.pieces(PATH)
    assert v.decode(v.encode([text])[0]) == text


def test_like_the_library_s_unigram_segmentation(tmp_path):
    """The library segments with the same scores once the model file says so: model type 1, and the law's scores."""
    import struct

    import sentencepiece as library

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(tag, data):
        return number(tag << 3 | 2) + number(len(data)) + data

    model = library.SentencePieceProcessor(model_file=PATH)
    mine = sentencepiece.Pieces.load(PATH)
    out = b""
    for i in range(model.get_piece_size()):
        kind = 2 if model.is_unknown(i) else 3 if model.is_control(i) else 6 if model.is_byte(i) else 1
        out += field(1, field(1, model.id_to_piece(i).encode()) + number(2 << 3 | 5) + struct.pack("<f", mine.scores[i]) + number(3 << 3) + number(kind))
    out += field(2, number(3 << 3) + number(1) + number(35 << 3) + number(1)) + field(3, field(1, b"identity") + number(3 << 3) + number(1) + number(4 << 3) + number(0) + number(5 << 3) + number(1))
    (tmp_path / "m").write_bytes(out)
    unigram = library.SentencePieceProcessor(model_file=str(tmp_path / "m"))
    for text in ("This is the first of many internationalization tests", "un deux trois, quatre", "Straßenverkehr  und漢 so"):
        want, got = unigram.encode(text), np.frombuffer(mine.encode([text])[0], "<u4").tolist()
        total = lambda ids: sum(mine.scores[i] for i in ids if not model.is_byte(int(i)))
        assert total(got) == pytest.approx(total(want), abs=1e-2) and len(got) == len(want)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab ▁\nxé😀"), min_size=1, max_size=40), st.integers(1, 9))
def test_long_words_advance_like_short_ones(text, window):
    v = small(("b▁a",))
    before, sentencepiece.WINDOW = sentencepiece.WINDOW, window
    try:
        assert v.segment_long(text) == v.segment([text])[0]
    finally:
        sentencepiece.WINDOW = before


def test_words_of_many_lengths_at_once(real):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh漢字0123"), n)) for n in [*range(1, 90), 500, 1000, 1024, 1025, 3000]]
    v = sentencepiece.Pieces.load(PATH)
    together = v.encode([" ".join(words)])[0]
    assert max(map(len, v.known)) <= sentencepiece.REMEMBERED_CHARS
    apart = [v.segment([" " + w])[0] for w in words]
    assert np.frombuffer(together, "<u4").tolist() == [i for ids in apart for i in ids]


def test_the_model_s_space_in_front(real):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=PATH)
    for text in ("Hello world", "the", "", "a", "the end"):
        assert np.frombuffer(real.encode([text])[0], "<u4").tolist() == model.encode(text)
    assert real.prefix and real.normalize is None


def test_a_model_that_changes_characters():
    v = sentencepiece.Pieces([None] * 256 + ["▁", "a"], np.concatenate([np.zeros(256), [-1.0, -1.0]]), {i: i for i in range(256)}, normalize=lambda t: ("▁" + t.lower()).replace(" ", "▁"))
    assert v.decode(v.encode(["A a"])[0]) == " a a"


def test_time_of_a_text_without_spaces(real):
    text = "aGVsbG8gd29ybGQhIFRoaXMgaXMgYmFzZTY0" * 30_000
    began = time.perf_counter()
    assert real.decode(real.encode([text])[0]) == text
    assert time.perf_counter() - began < 20


def test_long_and_odd_texts(real):
    for text in ("", " ", "   ", "x" * 5000, "a b " * 20_000, "▁▁ ▁", "\n\n\t x\r\n", "漢字" * 800):
        assert real.decode(real.encode([text])[0]) == text


def test_rows(spark):
    df = spark.createDataFrame([(1, "a b", 7), (None, None, 8), (2, "", 9), (2, "", 9)], "doc_id long, text string, ids int")
    rows = sentencepiece.encoded(df, PATH)
    back = sentencepiece.decoded(rows, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_pieces, r.round_trip, r.text) for r in back) == [(0, 0, True, ""), (1, 2, True, "a b"), (2, 0, True, ""), (2, 0, True, "")]
    assert sentencepiece.encoded(df.limit(0), PATH).collect() == []


def test_query(spark, real):
    docs = {r.doc_id: r.text for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    got = sentencepiece.op3_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = real.encode([docs[r.doc_id]])[0]
        assert r.round_trip and (r.n_pieces, r.ids_crc32) == (len(ids) // 4, zlib.crc32(ids))
