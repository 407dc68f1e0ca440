from collections import defaultdict

import pyarrow.parquet as pq

import corpus_pipeline as pipeline
from forkscope.llm import langid, mixing, ngram_join, quality, sentencepiece

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
        if name != pipeline.STAGES[-1][0]:
            assert kept[-1].columns == docs.columns
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[1] == {r.doc_id for r in langid.identified(docs, host="source").where(langid.accepted()).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids[2] == {r.doc_id for r in quality.scored(kept[1], labels).where(quality.selected()).collect()}
    groups = defaultdict(set)
    for r in ngram_join.components_of(kept[2], pipeline.NEAR_WORDS, pipeline.NEAR_PERCENT).collect():
        groups[r.component_id].add(r.doc_id)
    assert ids[3] == {min(g) for g in groups.values()} and len(ids[3]) < len(ids[2])
    assert ids[4] == ids[3] == ids[5]
    place = {r.doc_id: r.mix_position for r in mixing.mixed(kept[3]).collect()}
    assert {r.doc_id: r.mix_position for r in kept[5].collect()} == place
    texts, v = {r.doc_id: r.text for r in docs.collect()}, sentencepiece.pieces(sentencepiece.default_path())
    for r in kept[5].collect():
        text = texts[r.doc_id]
        # The model puts a space in front.
        assert r.round_trip and len(r.ids) == r.n_pieces and b"".join(v.raw[i] for i in r.ids).decode() == (f" {text}" if text and v.prefix else text)


def test_run_keeps_the_mixture_through_its_files(spark, tmp_path):
    pipeline.run(spark, SF).write.parquet(str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert 50 < len(rows) <= 200 and len({r.doc_id for r in rows}) == len(rows)
    assert sorted(r.mix_position for r in rows) == list(range(len(rows)))
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = mixing.mixed(spark.createDataFrame([(r.doc_id, docs[r.doc_id]) for r in rows], "doc_id long, source string")).collect()
    assert {r.doc_id: r.mix_position for r in rows} == {r.doc_id: r.mix_position for r in want}
    # The files by name, and their rows, are in the order of the mixture.
    files = [[r["mix_position"] for r in pq.read_table(f).to_pylist()] for f in sorted((tmp_path / "out").glob("part-*"))]
    assert [x for f in files for x in f] == list(range(len(rows)))


def test_places_of_rows_that_no_file_holds(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.mix_position for r in pipeline.sentencepiece_ids(spark, docs, SF).collect()] == [None]


def test_near_duplicates_with_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text, "en", "s", 1), (3, text, "en", "s", 1), (None, text, "en", "s", 1), (7, None, "en", "s", 0), (8, "", "en", "s", 0), (3, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(((r.doc_id is None, r.doc_id) for r in got), key=str) == sorted([(False, 3), (False, 7), (False, 8), (True, None)], key=str)


def test_near_duplicates_by_five_words_and_80_percent(spark):
    words = [f"w{i}" for i in range(454)]  # 450 five-word shingles

    def edited(n):
        return " ".join("x" * (i // 40 + 1) if i % 40 == 20 and i // 40 < n else w for i, w in enumerate(words))

    def kept(n):
        rows = [(1, " ".join(words), "en", "s", 1), (2, edited(n), "en", "s", 1)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        return [r.doc_id for r in pipeline.near_duplicates(spark, docs, SF).collect()]

    # 400 shingles of 500 are shared after ten edits (411 of 491 by four words), 395 of 505 after eleven.
    assert kept(10) == [1] and sorted(kept(11)) == [1, 2]


def test_columns_that_clash_with_the_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS language", "*", "n_chars AS component_id", "doc_id + 1 AS mix_block", "'x' AS posterior", "doc_id AS ids")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r.language == r.doc_id == r.ids and r.component_id == r.n_chars and r.mix_block == r.doc_id + 1 and r.posterior == "x" for r in rows)
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
