"""Language identification by fusing independent evidence.

The log posterior of a language adds up the log likelihood of the text's byte
4-grams (tempered, since they overlap), that of the declared markup language
given the true one, that of the address's language hints (country suffix, first
part of the path), and a host prior. Host priors are smoothed in steps, host to
suffix to all documents, from counts by grouped aggregation over all rows. One
more class, of texts in no known language, has all 4-grams alike likely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, html_extract, shingles

#: Documents of each language that its likelihoods are fitted to, chosen by the hash of their id; every declared language is fitted.
FITTED = 1000
#: Languages whose counts a task holds at once, and with which SENT_HOSTS holds.
HELD = 64
CELLS = 1 << 16
#: Weight of a 4-gram, pseudo-count of a cell, of a level of the host prior, error rate of a declaration, and factor of an address hint.
TEMPER, PSEUDO, LEVEL, WRONG, HINT = 0.25, 0.5, 10.0, 0.05, 4.0
#: Hosts whose priors are sent to all tasks at most; beyond that rows are joined by salted host.
SENT_HOSTS, SALTS = 100_000, 64
#: Prior of a text in no known language.
UNKNOWN = 1e-4
#: A posterior below this leaves the language undetermined.
LEAST_POSTERIOR = 0.5
# Country suffixes by language.
SUFFIXES = {"de": "de", "at": "de", "li": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es", "pe": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "se": "sv", "jp": "ja", "cn": "zh", "kr": "ko"}

#: Bytes of letters keep their value (A-Z as a-z), all others count as a space.
FOLD = np.array([b + 32 if 0x41 <= b < 0x5B else b if 0x61 <= b < 0x7B or b >= 0x80 else 0x20 for b in range(256)], np.uint8)


def cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the byte 4-grams with two letters at least, in text order, and their number in each text."""
    data = FOLD[np.frombuffer(b"    ".join([b"", *texts, b""]), np.uint8)]
    wide = data.astype(np.uint32)
    grams = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    letters = np.cumsum(np.concatenate([[0], data != 0x20]))
    good = letters[4:] - letters[:-4] >= 2
    ends = np.cumsum([len(t) + 4 for t in texts]) if texts else np.zeros(0, int)
    at = np.flatnonzero(good)
    mixed = grams[at] * np.uint32(0x9E3779B1)
    return (mixed >> np.uint32(16)).astype(np.int32), np.diff(np.searchsorted(at, ends), prepend=0)


class Model:
    """Log probability of each cell under each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.table = np.zeros((CELLS, len(languages)), np.float32)
        for i, own in enumerate(counts):
            self.table[:, i] = np.log((own + PSEUDO) / (own + PSEUDO).sum())

    def likelihoods(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods by text and language, and the number of grams."""
        at, many = cells(texts)
        out, end = np.zeros((len(texts), len(self.languages))), 0
        for i, m in enumerate(many.tolist()):
            if m:
                out[i] = self.table[at[end : end + m]].sum(0, dtype=np.float64)
            end += m
        return out, many


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def suffix_of(host: Column) -> Column:
    """The last label of a host name with several; empty otherwise."""
    return F.regexp_extract(host, r"\.([a-z]+)\.?$", 1)


def path_of(url: Column) -> Column:
    """The first part of the path if it looks like a language code; empty otherwise."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*/([a-zA-Z]{2})(?:[-_][a-zA-Z]{2})?(?=[/?#]|$)", 1))


def _counted(languages: list[str]):
    def counted(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        found = [(k, np.flatnonzero(n)) for k, n in total.items()]
        row, cell, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([np.full(len(c), k) for k, c in found], [c for _, c in found], [total[k][c] for k, c in found]))
        return pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int64))], ["language", "cell", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        index = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            declared = batch.column("declared").to_pylist()
            for first, texts in shingles.slices(batch.column("text")):
                at, many = cells(texts)
                end = 0
                for i, m in enumerate(many.tolist()):
                    k = index[declared[first + i]]
                    if k not in total and len(total) == HELD:
                        yield counted(total)
                        total.clear()
                    total[k] = total.get(k, 0) + np.bincount(at[end : end + m], minlength=CELLS)
                    end += m
        yield counted(total)

    return count


def fitted(docs: DataFrame, key: str) -> Model:
    """docs: key, text, declared. The languages are all those declared."""
    known = docs.where("declared <> ''").groupBy("declared").agg(F.count("*").alias("n")).collect()
    languages = sorted(r.declared for r in known)
    if not languages:
        return Model([], np.zeros((0, CELLS)))
    # Twice the ids wanted of each language, by their hash; the exact choice is then made among few.
    part = F.xxhash64(key).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    share = F.create_map(*[F.lit(x) for r in known for x in (r.declared, min(1.0, (2 * FITTED + 100) / r.n))])
    rank = F.row_number().over(Window.partitionBy("declared").orderBy(F.xxhash64(key), key))
    chosen = docs.where(F.col("declared").isin(languages)).where(part <= F.try_element_at(share, F.col("declared"))).select(key, "declared").withColumn("r", rank).where(F.col("r") <= FITTED)
    # FITTED ids a language at most, and one text of each: of rows that repeat an id the one with the least hash.
    sample = docs.join(F.broadcast(chosen.select(key, "declared").distinct()), [key, "declared"]).groupBy(key, "declared").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "declared")
    got = sample.mapInArrow(_counted(languages), "language int, cell int, n long").groupBy("language", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), CELLS))
    counts[got["language"].to_numpy(), got["cell"].to_numpy()] = got["n"].to_numpy()
    return Model(languages, counts)


def _identify(shared):
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        languages, n = model.languages, len(model.languages)
        index = {x: i for i, x in enumerate(languages)}
        said = np.full((n, n), np.log(WRONG / max(1, n - 1))) if n else np.zeros((0, 0))
        np.fill_diagonal(said, np.log(1 - WRONG) if n > 1 else 0.0)
        for batch in batches:
            rest = batch.drop_columns(["__text", "__declared", "__suffix", "__path", "__prior"])
            declared, suffix, path = (batch.column(c).to_pylist() for c in ("__declared", "__suffix", "__path"))
            prior = np.log(batch.column("__prior").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), n))
            best, sure = [], []
            for first, texts in shingles.slices(batch.column("__text")):
                log, many = model.likelihoods(texts)
                log = TEMPER * log + prior[first : first + len(texts)]
                for i in range(len(texts)):
                    if not n or not many[i]:
                        best.append(None)
                        sure.append(0.0)
                        continue
                    row = log[i]
                    none = TEMPER * many[i] * -np.log(CELLS) + np.log(UNKNOWN)
                    if declared[first + i] in index:
                        row = row + said[index[declared[first + i]]]
                        none -= np.log(n)
                    for hint in (SUFFIXES.get(suffix[first + i]), path[first + i]):
                        if hint in index:
                            row = row.copy()
                            row[index[hint]] += np.log(HINT)
                    top = max(row.max(), none)
                    row, none = np.exp(row - top), np.exp(none - top)
                    k = int(row.argmax())
                    best.append(languages[k] if row[k] >= none else None)
                    sure.append(float(row[k] / (row.sum() + none)) if row[k] >= none else 0.0)
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(best, pa.string()), pa.array(sure, pa.float64())], [*rest.schema.names, "language", "posterior"])

    return identify


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text", declared: str | None = "lang", url: str | None = None, host: str | None = None) -> DataFrame:
    """docs with language (null if undetermined) and posterior; columns of docs by these names are replaced.

    A text without letters, one whose 4-grams no language makes likely, and any
    text where no row declares a language, is undetermined. Null declarations,
    addresses and hosts are no evidence (a null host shares one prior). Texts of
    any length are read whole. Repeated rows are judged alike and all rows stay;
    the fit takes one text of a repeated key. Of equal posteriors the language
    first in the alphabet is taken; an empty table gives no rows.
    """
    spark = docs.sparkSession
    common.modest_batches(spark)
    given = docs.drop("language", "posterior")
    address = F.coalesce(F.col(url), F.lit("")) if url else F.lit("")
    own = F.coalesce(F.col(host).cast("string"), F.lit("")) if host else host_of(address)
    evidence = {"__text": F.coalesce(F.col(text).cast("string"), F.lit("")), "__declared": F.coalesce(F.lower(F.regexp_extract(F.col(declared), r"^\s*([A-Za-z]+)", 1)), F.lit("")) if declared else F.lit(""), "__host": own, "__suffix": suffix_of(own), "__path": path_of(address)}
    rows = given.select("*", *(c.alias(k) for k, c in evidence.items()))
    model = fitted(rows.select(key, F.col("__text").alias("text"), F.col("__declared").alias("declared")), key)
    names = model.languages
    told = rows.groupBy("__suffix", "__host", "__declared").agg(F.count("*").alias("n"))
    listed = F.array(*[F.lit(x) for x in names]).cast("array<string>")

    def level(by: list[str], to: str) -> DataFrame:
        n = told.groupBy(*by, "__declared").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__declared", "n"))).alias("m"))
        return n.select(*by, F.transform(listed, lambda x: F.coalesce(F.try_element_at("m", x), F.lit(0)).cast("double")).alias(to))

    def smoothed(n: str, above: Column) -> Column:
        total = F.aggregate(F.col(n), F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(F.col(n), above, lambda x, p: (x + LEVEL * p) / (total + LEVEL))

    hosts = level(["__suffix", "__host"], "n_host")
    suffixes = level(["__suffix"], "n_suffix")
    whole = {r["__declared"]: float(r["n"]) for r in told.groupBy("__declared").agg(F.sum("n").alias("n")).where(F.col("__declared").isin(names)).collect()}
    overall = [whole.get(x, 0.0) for x in names]
    base = F.array(*[F.lit((x + 1) / (sum(overall) + len(names))) for x in overall]).cast("array<double>")
    suffixes = suffixes.withColumn("p_suffix", smoothed("n_suffix", base)).select("__suffix", "p_suffix")
    priors = hosts.join(suffixes, "__suffix").withColumn("__prior", smoothed("n_host", F.col("p_suffix"))).select("__suffix", "__host", "__prior")
    priors = common.stored(priors, "priors")
    if priors.count() <= SENT_HOSTS * min(1.0, HELD / max(1, len(names))):
        rows = rows.join(F.broadcast(priors), ["__suffix", "__host"])
    else:
        salt = F.pmod(F.xxhash64(key, "__text"), F.lit(SALTS).cast("long"))
        many = priors.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = rows.withColumn("__salt", salt).join(many, ["__suffix", "__host", "__salt"])
    rows = rows.select(*given.columns, "__text", "__declared", "__suffix", "__path", "__prior")
    schema = given.select("*", F.lit("").alias("language"), F.lit(0.0).alias("posterior")).schema
    schema["language"].nullable = True
    return rows.mapInArrow(_identify(spark.sparkContext.broadcast(model)), schema)


def accepted() -> Column:
    return F.col("language").isNotNull() & (F.col("posterior") >= LEAST_POSTERIOR)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document from its text, its declared language and its source."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return identified(docs, host="source").select("doc_id", "lang", "language", "posterior", accepted().alias("accepted"))


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every page: from its main text, its markup's language, its address and its host."""
    pages = common.table(spark, sf_dir, "pages")
    rows = html_extract.extracted(pages, declared=html_extract.declared_language(F.col("html")))
    # Stored once: the text is read by the fit and by the scoring.
    rows = common.stored(rows, "pages")
    return identified(rows, key="page_id", declared="declared", url="url").select("page_id", "url", "declared", "language", "posterior", accepted().alias("accepted"))
