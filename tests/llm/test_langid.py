import numpy as np
import pytest

from forkscope.llm import common, langid


def test_cells_like_slices():
    texts = [b"Abc d,e", b"", b"  ", "é".encode(), b"ab"]
    at, many = langid.cells(texts)
    end = 0
    for t, m in zip(texts, many):
        padded = langid.FOLD[np.frombuffer(b"    " + t + b"    ", np.uint8)].tobytes()
        grams = [padded[i : i + 4] for i in range(1, len(padded) - 4)] if t else []
        want = [int(np.uint32(int.from_bytes(g, "little")) * np.uint32(0x9E3779B1) >> np.uint32(16)) for g in grams if 4 - g.count(b" ") >= 2]
        assert at[end : end + m].tolist() == want
        end += m


def test_addresses(spark):
    from pyspark.sql import functions as F

    rows = [("https://u@WWW.Example.de:80/fr/x", "www.example.de", "de", "fr"), ("http://a.co.uk/en-GB?x", "a.co.uk", "uk", "en"), ("x", "", "", ""), ("http://localhost/eng/", "localhost", "", ""), ("http://1.2.3.4/de", "1.2.3.4", "", "de")]
    got = spark.createDataFrame(rows, "u string, h string, s string, p string").select("*", langid.host_of(F.col("u")), langid.suffix_of(langid.host_of(F.col("u"))), langid.path_of(F.col("u"))).collect()
    for r in got:
        assert tuple(r[4:]) == (r.h, r.s, r.p)


def brute(rows, languages, model):
    """Posteriors by plain loops, with the model's table."""
    from collections import Counter

    by_host, by_suffix, overall = Counter(), Counter(), Counter()
    for _, _, lang, host in rows:
        by_host[host, lang] += 1
        by_suffix[lang] += 1
        overall[lang] += 1
    out = {}
    known = {x: overall[x] for x in languages}
    for i, text, lang, host in rows:
        base = {x: (known[x] + 1) / (sum(known.values()) + len(languages)) for x in languages}
        n = sum(known.values())
        suffix = {x: (known[x] + langid.LEVEL * base[x]) / (n + langid.LEVEL) for x in languages}
        m = sum(by_host[host, x] for x in languages)
        prior = {x: (by_host[host, x] + langid.LEVEL * suffix[x]) / (m + langid.LEVEL) for x in languages}
        at, _ = langid.cells([(text or "").encode()])
        logs = []
        for k, x in enumerate(languages):
            v = langid.TEMPER * model.table[at, k].sum(dtype=float) + np.log(prior[x])
            if lang in languages:
                v += np.log(1 - langid.WRONG if x == lang else langid.WRONG / (len(languages) - 1))
            logs.append(v)
        none = np.log(langid.UNKNOWN) - langid.TEMPER * len(at) * np.log(langid.CELLS) - (np.log(len(languages)) if lang in languages else 0)
        if none > max(logs):
            out[i] = (None, 0.0)
            continue
        logs.append(none)
        p = np.exp(np.array(logs) - max(logs))
        out[i] = (languages[int(p.argmax())], p.max() / p.sum()) if len(at) else (None, 0.0)
    return out


def test_many_hosts_and_a_bounded_fit(spark, monkeypatch):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    want = sorted(tuple(r) for r in langid.identified(docs, host="source").collect())
    monkeypatch.setattr(langid, "SENT_HOSTS", 3)
    assert sorted(tuple(r) for r in langid.identified(docs, host="source").collect()) == want
    table = docs.selectExpr("doc_id", "text", "lang AS declared")
    monkeypatch.setattr(langid, "FITTED", 5)
    few = langid.fitted(table, "doc_id")
    monkeypatch.setattr(langid, "FITTED", 10**6)
    every = langid.fitted(table, "doc_id")
    assert few.languages == every.languages and (few.table != every.table).any()


def test_query(spark):
    docs = [tuple(r) for r in common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang", "source").collect()]
    table = spark.createDataFrame([(i, t, d) for i, t, d, _ in docs], "doc_id long, text string, declared string")
    model = langid.fitted(table, "doc_id")
    want = brute(docs, model.languages, model)
    got = langid.op8_language_id(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.language == want[r.doc_id][0] and r.posterior == pytest.approx(want[r.doc_id][1], abs=1e-6)
        assert r.accepted == (r.posterior >= langid.LEAST_POSTERIOR)


def test_held_out_accuracy(spark):
    """Texts without any declared language, on documents that the model was not fitted to."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").where("length(text) > 100")
    fit = docs.where("doc_id % 2 = 0").selectExpr("doc_id", "text", "lang AS declared")
    model = langid.fitted(fit, "doc_id")
    rest = docs.where("doc_id % 2 = 1").select("text", "lang").collect()
    logs, _ = model.likelihoods([r.text.encode() for r in rest])
    right = [model.languages[k] == r.lang for k, r in zip(logs.argmax(1), rest)]
    assert sum(right) / len(right) > 0.97


def test_evidence_and_odd_rows(spark):
    rows = [(i, "the cat and the dog of the house" if i % 2 else "der hund und die katze des hauses", "en" if i % 2 else "de", f"http://h{i % 3}.example.com/", "x", 0.5) for i in range(40)]
    rows += [(100, None, "en", None, "x", 0.5), (101, "", None, "", "x", 0.5), (102, "123 !!!", "en", "u", "x", 0.5), (103, "zz zq", None, "http://a.de/", "x", 0.5), (104, "zz zq", None, "http://a.example.com/en/x", "x", 0.5), (None, "der hund", "de", "u", "x", 0.5), (1, *rows[1][1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string, language string, posterior double")
    got = langid.identified(df, url="url").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.language for r in got}
    assert by[1] == "en" and by[2] == "de" and by[100] is None and by[101] is None and by[102] is None and by[103] == "de" and by[104] == "en" and by[None] == "de"
    assert langid.identified(df.limit(0)).collect() == []
    silent = langid.identified(df.drop("lang"), declared=None)
    assert {r.language for r in silent.collect()} == {None}


def test_repeated_ids_and_long_texts_and_junk(spark, monkeypatch):
    en, de = "the cat and the dog of the house ", "der hund und die katze des hauses "
    rows = [(i, (en if i % 2 else de) * 20, "en" if i % 2 else "de", "s") for i in range(40)]
    rows += [(1, en + str(i), "en", "s") for i in range(3000)] + [(50, en * 30_000, "en", "s"), (51, "a" * 1_000_000, "en", "s"), (52, "qzvx jkqw xzzq vvqj wqxk zxqj kqzv " * 40, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(langid, "FITTED", 8)
    sample = df.selectExpr("doc_id", "text", "lang AS declared")
    model = langid.fitted(sample, "doc_id")
    once = langid.fitted(sample.dropDuplicates(["doc_id"]).where("doc_id <> 1"), "doc_id")
    assert model.languages == once.languages == ["de", "en"]
    monkeypatch.undo()
    got = {r.doc_id: r for r in langid.identified(df, host="source").collect()}
    assert got[50].language == "en" and got[2].language == "de" and got[52].language is None and got[52].posterior == 0.0


def test_more_than_64_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 7)
    codes = [a + b for a in "abcdefghij" for b in "klmnopq"]  # 70, the last ones declared less often
    words = {x: " ".join(f"{x}{y}{x[::-1]}{z}" for y in "rstuv" for z in "wxyz") for x in codes}
    rows = [(2 * i + j, words[x], x, f"h{i % 5}") for i, x in enumerate(codes) for j in range(2 if i < 60 else 1)]
    df = spark.createDataFrame([*rows, (1000, words[codes[-1]], None, None)], "doc_id long, text string, lang string, source string")
    got = langid.identified(df, host="source").withColumn("accepted", langid.accepted()).collect()
    assert len(got) == len(rows) + 1
    assert all(r.language == (r.lang or codes[-1]) and r.accepted for r in got)


def test_pages(spark):
    pages = {r.page_id: r for r in common.table(spark, "/root/testdata/sf0.001", "pages").collect()}
    got = langid.page_language_id(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(pages)
    for r in got:
        assert f'<html lang="{r.declared}">' in pages[r.page_id].html
    assert sum(r.language == r.declared for r in got) / len(got) > 0.95
