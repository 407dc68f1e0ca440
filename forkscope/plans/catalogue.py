"""The engine's queries over the driver's tables, and the same in SQL.

Documents are snapshots, conversations append histories; edits, parents and
reads come from integer arithmetic on ids, so that both engines plan alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import native, states
from ..operators import checkpoints, corpus, dedup, pieces, prepare, report, versions
from ..operators.ranks import ranked
from ..sources import manifests
from ..storage import dropped, new_path, stored
from . import runner
from .workload import TEMPLATES, Config, Kind

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        FOUND[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, state, n of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.coalesce("text", F.lit("")).cast("binary").alias("state")).withColumn("n", states.state_len("state"))


DOCS = "d AS (SELECT doc_id, source, encode(coalesce(text, '')) AS state, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents)"


# -- states ---------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT conv_id, turn, encode(string_agg(coalesce(text, ''), '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS state FROM conversations),
r AS (SELECT *, octet_length(state)::BIGINT AS len, least(64, octet_length(state))::BIGINT AS read_len FROM s)
SELECT conv_id, turn, len, md5(state) AS state_md5, md5(state[(len - read_len) // 2 + 1 : (len - read_len) // 2 + read_len]) AS read_md5 FROM r
""")
def append_history(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    rows = versions.append_history(turns, "conv_id", "turn", F.coalesce("text", F.lit("")).cast("binary"))
    rows = rows.withColumn("len", states.state_len("state")).withColumn("read_len", F.least(F.lit(64).cast("long"), "len"))
    read = states.read_range("state", F.expr("(len - read_len) div 2"), F.col("read_len"))
    return rows.select("conv_id", "turn", "len", F.md5("state").alias("state_md5"), F.md5(read).alias("read_md5"))


@query(f"WITH {DOCS} SELECT doc_id, n AS len, n = 0 AS is_empty, md5(state) AS state_md5 FROM d")
def create_and_len(spark, sf_dir):
    return snapshots(spark, sf_dir).select("doc_id", F.col("n").alias("len"), (F.col("n") == 0).alias("is_empty"), F.md5("state").alias("state_md5"))


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an edit each: insert, delete, replace or append by doc_id modulo 4."""
    rows = snapshots(spark, sf_dir)
    kind = F.col("doc_id") % 4
    start = F.when(kind == 3, F.col("n")).otherwise((F.col("doc_id") * 131) % (F.col("n") + 1))
    rows = rows.withColumn("start", start)
    delete_len = F.when(kind.isin(1, 2), F.least(F.lit(11).cast("long"), F.col("n") - F.col("start"))).otherwise(F.lit(0).cast("long"))
    insert = F.when(kind == 1, F.lit("")).otherwise(F.concat(F.lit("<"), F.col("doc_id").cast("string"), F.lit(">"))).cast("binary")
    return rows.withColumn("delete_len", delete_len).withColumn("insert", insert)


EDITED = DOCS + """, e0 AS (SELECT *, CASE WHEN doc_id % 4 = 3 THEN n ELSE (doc_id * 131) % (n + 1) END AS start FROM d),
e AS (SELECT *, CASE WHEN doc_id % 4 IN (1, 2) THEN least(11, n - start) ELSE 0 END AS delete_len, encode(CASE WHEN doc_id % 4 = 1 THEN '' ELSE '<' || doc_id || '>' END) AS ins FROM e0)"""


@query(f"""
WITH {EDITED} SELECT doc_id, CASE WHEN delete_len = 0 AND octet_length(ins) = 0 THEN 'none' WHEN delete_len = 0 AND start = n THEN 'append' WHEN delete_len = 0 THEN 'insert' WHEN octet_length(ins) = 0 THEN 'delete' ELSE 'replace' END AS kind,
(n - delete_len + octet_length(ins))::BIGINT AS output_len, md5(state[1:start] || ins || state[start + delete_len + 1 : n]) AS child_md5 FROM e
""")
def edit_kinds(spark, sf_dir):
    rows = edited(spark, sf_dir)
    child = states.splice("state", "start", "delete_len", "insert", strict=True)
    return rows.select("doc_id", states.edit_kind("start", "delete_len", "insert", "n").alias("kind"), states.output_len("n", "start", "delete_len", "insert").alias("output_len"), F.md5(child).alias("child_md5"))


@query(f"""
WITH {DOCS}, r AS (SELECT doc_id, n, (doc_id * 7919) % 4000 AS start, (doc_id * 31) % 500 AS size FROM d)
SELECT CASE WHEN start > n OR start + size > n THEN 'OutOfBounds' ELSE 'ok' END AS error_class, count(*) AS rows, sum(n)::BIGINT AS bytes,
max(CASE WHEN start > n OR start + size > n THEN 'edit/range out of bounds: len=' || n || ', start=' || start || ', delete_len=' || size END) AS sample_message FROM r GROUP BY 1
""")
def bounds_audit(spark, sf_dir):
    rows = snapshots(spark, sf_dir).select("n", (F.col("doc_id") * 7919 % 4000).alias("start"), (F.col("doc_id") * 31 % 500).alias("size"))
    kind = F.coalesce(states.range_error("n", "start", "size"), F.lit("ok"))
    return rows.groupBy(kind.alias("error_class")).agg(F.count("*").alias("rows"), F.sum("n").alias("bytes"), F.max(states.error_message("n", "start", "size")).alias("sample_message"))


@query(f"""
WITH {DOCS}, r AS (SELECT *, least(100, n) AS read_len FROM d), s AS (SELECT *, (doc_id * 257) % (n - read_len + 1) AS read_start FROM r)
SELECT doc_id, read_start, read_len::BIGINT AS read_len, md5(state[read_start + 1 : read_start + read_len]) AS read_md5 FROM s
""")
def range_read(spark, sf_dir):
    rows = snapshots(spark, sf_dir).withColumn("read_len", F.least(F.lit(100).cast("long"), "n"))
    rows = rows.withColumn("read_start", F.col("doc_id") * 257 % (F.col("n") - F.col("read_len") + 1))
    return rows.select("doc_id", "read_start", "read_len", F.md5(states.read_range("state", "read_start", "read_len")).alias("read_md5"))


@query(f"""
WITH {DOCS}, a AS (SELECT doc_id, state, n, least(5, n) AS cut FROM d), b AS (SELECT doc_id, encode('head ') || state[cut + 1 : n] AS s FROM a),
c AS (SELECT doc_id, s || encode(' tail') AS s FROM b), f AS (SELECT doc_id, s[1 : octet_length(s) // 2] || encode('-mid-') || s[octet_length(s) // 2 + 1 : octet_length(s)] AS s, octet_length(s) AS m FROM c)
SELECT doc_id, 3 AS edits, octet_length(s)::BIGINT AS len, md5(s) AS state_md5 FROM f
""")
def script_fold(spark, sf_dir):
    rows = snapshots(spark, sf_dir)
    cut = F.least(F.lit(5).cast("long"), F.col("n"))
    after = F.col("n") - cut + 10
    edit = lambda s, d, i: F.struct(s.cast("long").alias("start"), d.cast("long").alias("delete_len"), F.lit(i).cast("binary").alias("insert"))
    script = F.array(edit(F.lit(0), cut, "head "), edit(F.col("n") - cut + 5, F.lit(0), " tail"), edit(F.floor(after / 2), F.lit(0), "-mid-"))
    rows = rows.withColumn("script", script)
    return rows.select("doc_id", F.size("script").alias("edits"), states.apply_script("state", "script").alias("s")).select("doc_id", "edits", states.state_len("s").alias("len"), F.md5("s").alias("state_md5"))


# -- version graphs -------------------------------------------------------------------------


def graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every document after the first of its source is a version: its parent is an earlier one of the source, its edit inserts its whole text."""
    docs = snapshots(spark, sf_dir)
    ids = stored(ranked(docs.select("doc_id", "source"), ["source"], ["doc_id"], "k"), "ids")
    ids = ids.withColumn("up", F.when(F.col("k") > 0, (F.col("k") * 7919 % 10007) % F.col("k")))
    above = ids.select("source", F.col("k").alias("up"), F.col("doc_id").alias("parent_id"))
    roots = ids.where("k = 0").select("source", F.col("doc_id").alias("root_id"))
    ids = ids.join(above, ["source", "up"], "left").join(roots, "source").select(F.col("doc_id").alias("version_id"), "parent_id", "root_id")
    first = F.broadcast(roots.select(F.col("root_id").alias("doc_id")))  # one of each source: texts stay where they are
    start, size = F.col("doc_id") * 131 % 64, F.col("doc_id") % 11
    return {
        "version": ids,
        "edit": docs.where("source IS NOT NULL").join(first, "doc_id", "left_anti").select(F.col("doc_id").alias("version_id"), start.alias("start"), size.alias("delete_len"), F.col("state").alias("insert")),
        "base": docs.join(first, "doc_id", "left_semi").select(F.col("doc_id").alias("root_id"), F.concat("state", F.lit("." * 80).cast("binary")).alias("payload")),
    }


GRAPH = DOCS + """, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM d),
u AS (SELECT *, CASE WHEN k > 0 THEN ((k * 7919) % 10007) % k END AS up, min(doc_id) OVER (PARTITION BY source) AS root_id FROM k),
g AS (SELECT a.doc_id, a.root_id, a.state, b.doc_id AS parent_id, (a.doc_id * 131) % 64 AS start, a.doc_id % 11 AS delete_len, a.state AS ins FROM u a LEFT JOIN u b ON a.source = b.source AND a.up = b.k),
t AS (WITH RECURSIVE t(version_id, root_id, depth, state) AS (
  SELECT doc_id, root_id, 0, state || encode(repeat('.', 80)) FROM g WHERE parent_id IS NULL
  UNION ALL SELECT g.doc_id, g.root_id, t.depth + 1, t.state[1:g.start] || g.ins || t.state[g.start + least(g.delete_len, octet_length(t.state) - g.start) + 1 : octet_length(t.state)] FROM t JOIN g ON g.parent_id = t.version_id
) SELECT * FROM t)"""


@query(f"WITH {GRAPH} SELECT version_id, root_id, depth::INTEGER AS depth, octet_length(state)::BIGINT AS len, md5(state) AS state_md5 FROM t")
def graph_replay(spark, sf_dir):
    t = graph(spark, sf_dir)
    rows = versions.replayed(t["version"], t["edit"], t["base"])
    return rows.select("version_id", "root_id", "depth", states.state_len("state").alias("len"), F.md5("state").alias("state_md5"))


@query(f"WITH {GRAPH} SELECT version_id, octet_length(state)::BIGINT AS len FROM t")
def graph_lengths(spark, sf_dir):
    t = graph(spark, sf_dir)
    return versions.lengths(t["version"], t["edit"], t["base"])


@query(f"""
WITH {GRAPH}, r AS (SELECT version_id, state, octet_length(state)::BIGINT AS n, least(96, octet_length(state))::BIGINT AS read_len FROM t), s AS (SELECT *, (version_id * 37) % (n - read_len + 1) AS read_start FROM r)
SELECT version_id, read_start, read_len, md5(state[read_start + 1 : read_start + read_len]) AS read_md5 FROM s
""")
def piece_range_read(spark, sf_dir):
    """Reads from piece tables: no version is built."""
    t = graph(spark, sf_dir)
    piece, buffers = pieces.piece_tables(t["version"], t["edit"], t["base"])
    sizes = piece.groupBy("version_id").agg(F.sum("len").alias("n")).withColumn("read_len", F.least(F.lit(96).cast("long"), "n"))
    reads = sizes.select("version_id", (F.col("version_id") * 37 % (F.col("n") - F.col("read_len") + 1)).alias("read_start"), "read_len")
    return pieces.read_ranges(reads, piece, buffers).select("version_id", "read_start", "read_len", F.md5("bytes").alias("read_md5"))


@query(f"WITH {GRAPH} SELECT count(*) AS versions, sum(octet_length(state))::BIGINT AS bytes, 0::BIGINT AS faults FROM t")
def piece_structure(spark, sf_dir):
    """Contiguity, lengths and bounds of all pieces."""
    t = graph(spark, sf_dir)
    piece, buffers = pieces.piece_tables(t["version"], t["edit"], t["base"])
    bad = pieces.faults(piece, buffers).select(F.lit(1).alias("bad"), F.lit(0).cast("long").alias("version_id"), F.lit(0).cast("long").alias("len"))
    rows = piece.select(F.lit(0).alias("bad"), "version_id", "len").union(bad)
    return rows.agg(F.countDistinct(F.when(F.col("bad") == 0, F.col("version_id"))).alias("versions"), F.sum("len").alias("bytes"), F.sum("bad").cast("long").alias("faults"))


@query("SELECT * FROM (VALUES (0, 0, 'base'), (1, 1, 'base-a'), (2, 2, 'base-a-b'), (3, 1, 'base-c')) t(version_id, depth, state_text)")
def sibling_fork(spark, sf_dir):
    """Edits are keyed by the version they make: siblings of one parent never see each other's."""
    version = spark.createDataFrame([(0, None, 0), (1, 0, 0), (2, 1, 0), (3, 0, 0)], "version_id int, parent_id int, root_id int")
    edit = spark.createDataFrame([(1, 4, 0, b"-a"), (2, 6, 0, b"-b"), (3, 4, 0, b"-c")], "version_id int, start long, delete_len long, insert binary")
    base = spark.createDataFrame([(0, b"base")], "root_id int, payload binary")
    long = version.select(*[F.col(c).cast("long").alias(c) for c in version.columns])
    rows = versions.replayed(long, edit.withColumn("version_id", F.col("version_id").cast("long")), base.withColumn("root_id", F.col("root_id").cast("long")), strict=True)
    return rows.select(F.col("version_id").cast("int").alias("version_id"), "depth", F.col("state").cast("string").alias("state_text"))


# -- sharing --------------------------------------------------------------------------------


@query("SELECT octet_length(encode(text))::BIGINT AS len, md5(encode(text)) AS payload_md5, count(*) AS copies FROM documents WHERE text <> '' GROUP BY text")
def exact_interning(spark, sf_dir):
    return dedup.interned(snapshots(spark, sf_dir).select("state"), "state").select("len", F.md5("state").alias("payload_md5"), "copies")


@query(f"""
WITH {EDITED}, p AS (SELECT state AS x, 'base' AS phase FROM e UNION ALL SELECT ins, 'final' FROM e), q AS (SELECT x, min(phase) AS phase FROM p WHERE octet_length(x) > 0 GROUP BY x),
s AS (SELECT sum(octet_length(x)) FILTER (phase = 'base')::BIGINT AS base_bytes, sum(octet_length(x))::BIGINT AS final_bytes, count(*) AS buffers FROM q), n AS (SELECT count(*) AS branches FROM documents)
SELECT base_bytes, final_bytes, buffers, greatest(0, final_bytes - base_bytes)::BIGINT AS growth, greatest(0, final_bytes - base_bytes) / greatest(1, branches) AS growth_per_branch FROM s, n
""")
def retained_growth(spark, sf_dir):
    """Interned payload bytes before and after one edit of each document."""
    rows = edited(spark, sf_dir)
    every = rows.select(F.col("state").alias("payload"), F.lit("base").alias("phase")).union(rows.select("insert", F.lit("final"))).where(F.octet_length("payload") > 0)
    size = F.octet_length("payload").cast("long")
    shared = every.groupBy(F.sha2("payload", 256).alias("d"), size.alias("len")).agg(F.min("phase").alias("phase"))
    one = shared.agg(F.sum(F.when(F.col("phase") == "base", F.col("len"))).alias("base_bytes"), F.sum("len").alias("final_bytes"), F.count("*").alias("buffers"))
    branches = rows.agg(F.count("*").alias("branches")).first()["branches"]
    return one.withColumn("growth", dedup.growth(F.col("final_bytes"), F.col("base_bytes"))).withColumn("growth_per_branch", dedup.per_branch(F.col("growth"), F.lit(branches)))


@query("""
WITH t(i, x) AS (VALUES """ + ", ".join(f"({i}, '{t.decode()}')" for i, t in enumerate(TEMPLATES)) + """),
p AS (SELECT p_partkey, substring(repeat(t.x, 30), 1, (p_size * 40)::INTEGER) AS payload, i FROM part JOIN t ON t.i = p_partkey % 4)
SELECT i::INTEGER AS template, count(*) AS uses, sum(length(payload))::BIGINT AS logical_bytes, count(DISTINCT payload) AS buffers, sum(DISTINCT length(payload))::BIGINT AS retained_bytes FROM p GROUP BY i
""")
def template_reuse(spark, sf_dir):
    """Payloads cut from repeated templates: what interning keeps of them."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 4).cast("int").alias("template"), (F.col("p_size") * 40).alias("size"))
    kinds = F.array(*[F.lit(t.decode()) for t in TEMPLATES])
    rows = rows.select("template", states.repeated(F.get(kinds, F.col("template")), F.col("size")).alias("payload"))
    shared = rows.groupBy("template", "payload").agg(F.count("*").alias("n"))
    size = F.octet_length("payload").cast("long")
    return shared.groupBy("template").agg(F.sum("n").alias("uses"), F.sum(size * F.col("n")).alias("logical_bytes"), F.count("*").alias("buffers"), F.sum(size).alias("retained_bytes"))


@query(f"WITH {DOCS} SELECT doc_id, generate_series AS ordinal, least(512, n - generate_series * 512)::BIGINT AS len, md5(state[generate_series * 512 + 1 : generate_series * 512 + 512]) AS leaf_md5 FROM d, generate_series(0, (n - 1) // 512) WHERE n > 0")
def fixed_leaves(spark, sf_dir):
    rows = dedup.leaves(snapshots(spark, sf_dir), "doc_id", "state", 512)
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "len", F.md5("payload").alias("leaf_md5"))


@query(f"WITH {DOCS} SELECT doc_id, n AS bytes, 0::BIGINT AS gaps FROM d WHERE n > 0")
def chunk_contiguity(spark, sf_dir):
    """Chunks follow each other and add up to their document."""
    manifest = dedup.chunk_manifest(snapshots(spark, sf_dir), "doc_id", "state", 256)
    before = F.lag(F.col("start") + F.col("len"), 1, 0).over(Window.partitionBy("doc_id").orderBy("ordinal"))
    return manifest.withColumn("gap", (before != F.col("start")).cast("long")).groupBy("doc_id").agg(F.sum("len").alias("bytes"), F.sum("gap").alias("gaps"))


@query()
def chunk_sharing(spark, sf_dir):
    """What content-defined chunks of all documents retain."""
    return dedup.chunk_stats(dedup.chunk_manifest(snapshots(spark, sf_dir), "doc_id", "state", 256))


@query(f"WITH {DOCS} SELECT doc_id, (n // 2)::BIGINT AS pos, md5(state[n // 2 + 1 : n // 2 + 1]) AS byte_md5 FROM d WHERE n > 0")
def chunk_lookup(spark, sf_dir):
    """The byte in the middle of each document, found through the chunk that holds it."""
    docs = snapshots(spark, sf_dir).where("n > 0")
    manifest = dedup.chunk_manifest(docs, "doc_id", "state", 256)
    offsets = docs.select("doc_id", F.expr("n div 2").alias("pos"))
    hit = dedup.chunk_at(manifest, "doc_id", offsets, "pos").select("doc_id", "pos", "start", "len")
    chunk = hit.join(docs.select("doc_id", "state"), "doc_id").withColumn("chunk", states.read_range("state", "start", "len"))
    return chunk.select("doc_id", "pos", F.md5(states.read_range("chunk", F.col("pos") - F.col("start"), F.lit(1))).alias("byte_md5"))


# -- differences ----------------------------------------------------------------------------


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, base, child: each document against the one before it in its source."""
    docs = snapshots(spark, sf_dir).select("doc_id", "source", "state")
    ids = ranked(docs.select("doc_id", "source"), ["source"], ["doc_id"], "k")
    pairs = ids.join(ids.select("source", (F.col("k") + 1).alias("k"), F.col("doc_id").alias("before")), ["source", "k"]).select("doc_id", "before")
    children = pairs.join(docs.select("doc_id", F.col("state").alias("child")), "doc_id")
    return children.join(docs.select(F.col("doc_id").alias("before"), F.col("state").alias("base")), "before").select("doc_id", "base", "child")


NEIGHBOURS = DOCS + ", p AS (SELECT doc_id, lag(state) OVER (PARTITION BY source ORDER BY doc_id) AS base, state AS child FROM d), q AS (SELECT * FROM p WHERE base IS NOT NULL)"
ENDS = """, m AS (SELECT *, hex(base) AS a, hex(child) AS b, octet_length(base) AS na, octet_length(child) AS nb, least(octet_length(base), octet_length(child)) AS lim FROM q),
x AS (SELECT *, coalesce(list_position(list_transform(range(0, lim), lambda i: a[2 * i + 1 : 2 * i + 2] <> b[2 * i + 1 : 2 * i + 2]), true) - 1, lim) AS pre FROM m),
y AS (SELECT *, coalesce(list_position(list_transform(range(0, lim - pre), lambda i: a[2 * (na - i) - 1 : 2 * (na - i)] <> b[2 * (nb - i) - 1 : 2 * (nb - i)]), true) - 1, lim - pre) AS suf FROM x)"""


@query(f"WITH {NEIGHBOURS}{ENDS} SELECT doc_id, pre::BIGINT AS start, (na - pre - suf)::BIGINT AS delete_len, md5(child[pre + 1 : nb - suf]) AS insert_md5 FROM y WHERE base <> child")
def local_diff(spark, sf_dir):
    rows = neighbours(spark, sf_dir).where("base <> child").select("doc_id", native.local_diff("base", "child", F.lit(0)).alias("e"))
    return rows.select("doc_id", "e.start", "e.delete_len", F.md5("e.insert").alias("insert_md5"))


@query(f"WITH {NEIGHBOURS} SELECT count(*) AS pairs, count(*) FILTER (base <> child) AS hunks, 0::BIGINT AS unfaithful, sum(octet_length(base) + octet_length(child))::BIGINT AS logical_bytes FROM q")
def reconstruct_guard(spark, sf_dir):
    """Every derived script, applied, gives the child back."""
    scripts = corpus.derived(neighbours(spark, sf_dir), "doc_id")
    wrong = (~states.apply_script("base", "script").eqNullSafe(F.col("child"))).cast("long")
    return scripts.agg(F.count("*").alias("pairs"), F.sum(F.size("script")).cast("long").alias("hunks"), F.sum(wrong).alias("unfaithful"), F.sum(states.state_len("base") + states.state_len("child")).alias("logical_bytes"))


def order_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as snapshots of their lines: (base, child) entries of each order against the one of the key before, laid out one after another."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.groupBy("l_orderkey", "l_linenumber").agg(F.concat_ws("|", F.max("l_partkey").cast("string"), F.max("l_returnflag"), F.max("l_linestatus")).alias("content"))
    rows = rows.select("l_orderkey", F.col("l_linenumber").cast("string").cast("binary").alias("path"), F.col("content").cast("binary").alias("bytes"))
    past = Window.partitionBy("l_orderkey").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.lit(27) + F.sum(F.octet_length("bytes")).over(past)
    rows = rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.octet_length("bytes"))
    child = rows.select(F.col("l_orderkey").alias("pair"), "path", "start", "end", "bytes")
    return rows.select((F.col("l_orderkey") + 1).alias("pair"), "path", "start", "end", "bytes"), child


LINES = """l AS (SELECT l_orderkey, encode(l_linenumber::VARCHAR) AS path, encode(concat_ws('|', max(l_partkey)::VARCHAR, max(l_returnflag), max(l_linestatus))) AS bytes FROM lineitem GROUP BY l_orderkey, l_linenumber),
s AS (SELECT *, 27 + sum(octet_length(bytes)) OVER (PARTITION BY l_orderkey ORDER BY path ROWS UNBOUNDED PRECEDING) AS e FROM l), ent AS (SELECT *, e - octet_length(bytes) AS s FROM s),
m AS (SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.path, b.path) AS path, a.s AS bs, a.e AS be, a.bytes AS bb, b.s AS cs, b.e AS ce, b.bytes AS cb, CASE WHEN a.pair IS NULL THEN 'added' WHEN b.pair IS NULL THEN 'deleted' ELSE 'common' END AS side
 FROM (SELECT l_orderkey + 1 AS pair, path, s, e, bytes FROM ent) a FULL JOIN (SELECT l_orderkey AS pair, path, s, e, bytes FROM ent) b ON a.pair = b.pair AND a.path = b.path),
w AS (SELECT *, sum((side = 'common')::INT) OVER (PARTITION BY pair ORDER BY path ROWS UNBOUNDED PRECEDING) AS gap, coalesce(max(be) FILTER (side = 'common') OVER (PARTITION BY pair ORDER BY path ROWS UNBOUNDED PRECEDING), 27) AS place FROM m),
r AS (SELECT pair, min(place)::BIGINT AS start, coalesce(sum(be - bs) FILTER (side = 'deleted'), 0)::BIGINT AS delete_len, coalesce(string_agg(decode(cb), '' ORDER BY path) FILTER (side = 'added'), '') AS ins FROM w WHERE side <> 'common' GROUP BY pair, gap)"""


@query(f"WITH {LINES} SELECT side, count(*) AS entries, count(*) FILTER (bb <> cb) AS modified FROM m GROUP BY side")
def path_merge(spark, sf_dir):
    rows = corpus.merged(*order_lines(spark, sf_dir), "pair")
    return rows.groupBy("side").agg(F.count("*").alias("entries"), F.count_if(F.col("base_bytes") != F.col("child_bytes")).alias("modified"))


@query(f"WITH {LINES} SELECT pair, start, delete_len, ins AS insert_text FROM r")
def run_edits(spark, sf_dir):
    rows = corpus.run_edits(corpus.merged(*order_lines(spark, sf_dir), "pair"), "pair")
    return rows.select("pair", "start", "delete_len", F.col("insert").cast("string").alias("insert_text"))


@query(f"WITH {LINES} SELECT pair, count(*)::INTEGER AS hunks, string_agg(start || ':' || delete_len || ':' || length(ins), ' ' ORDER BY start DESC, delete_len DESC) AS script FROM r GROUP BY pair")
def edit_ordering(spark, sf_dir):
    rows = corpus.run_edits(corpus.merged(*order_lines(spark, sf_dir), "pair"), "pair")
    text = lambda e: F.concat_ws(":", e["start"].cast("string"), e["delete_len"].cast("string"), F.octet_length(e["insert"]).cast("string"))
    return corpus.ordered(rows, "pair").select("pair", F.size("script").alias("hunks"), F.array_join(F.transform("script", text), " ").alias("script"))


#: Documents of a pack at most.
PACKED = 64


def pack_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, block, pack: the documents of a source in blocks of neighbouring ids, each by its place in its block."""
    docs = snapshots(spark, sf_dir)
    entry = docs.select("source", F.expr(f"doc_id div {PACKED}").alias("block"), F.lit(native.FILE).alias("kind"), F.lit(0o644).alias("mode"), (F.col("doc_id") % PACKED).cast("string").cast("binary").alias("path"), F.col("state").alias("content"))
    key = F.concat_ws("/", "source", F.col("block").cast("string"))
    return manifests.packs(entry.withColumn("pack_id", key), "pack_id").withColumn("block", F.substring_index("pack_id", "/", -1).cast("long")).withColumn("source", F.expr("left(pack_id, length(pack_id) - length(cast(block as string)) - 1)"))


def contents(entries: DataFrame, key: str) -> DataFrame:
    """Number, bytes and digest of the contents of each key's entries."""
    return entries.groupBy(key).agg(
        F.count("*").alias("entries"), F.sum(states.state_len("content")).alias("content_bytes"), F.max("end").alias("pack_bytes"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.md5("content").alias("m")))), lambda x: x["m"]), "")).alias("contents_md5"),
    )


PACKS = DOCS + f""", e AS (SELECT source, doc_id // {PACKED} AS block, source || '/' || (doc_id // {PACKED}) AS pack_id, encode((doc_id % {PACKED})::VARCHAR) AS path, state FROM d),
c AS (SELECT pack_id, source, block, count(*) AS entries, sum(octet_length(state))::BIGINT AS content_bytes, (27 + sum(17 + octet_length(path) + octet_length(state)))::BIGINT AS pack_bytes, md5(string_agg(md5(state), '' ORDER BY path)) AS contents_md5 FROM e GROUP BY ALL)"""


@query(f"WITH {PACKS} SELECT pack_id, entries, content_bytes, pack_bytes, contents_md5 FROM c")
def pack_round_trip(spark, sf_dir):
    """All documents written to packs, parsed again."""
    packs = stored(pack_tables(spark, sf_dir), "packs")
    return contents(corpus.entries(packs, "pack_id", "pack"), "pack_id")


@query(f"""
WITH {PACKS}, b AS (SELECT c.pack_id, p.pack_id AS before, p.entries AS base_entries FROM c JOIN c p ON c.source = p.source AND c.block = p.block + 1),
k AS (SELECT coalesce(x.pack_id, y.pack_id) AS pack_id, coalesce(x.path, y.path) AS path, CASE WHEN x.path IS NULL THEN 'a' WHEN y.path IS NULL THEN 'd' WHEN x.state <> y.state THEN 'm' ELSE 'c' END AS side
 FROM (SELECT b.pack_id, e.path, e.state FROM b JOIN e ON e.pack_id = b.before) x FULL JOIN (SELECT b.pack_id, e.path, e.state FROM b JOIN e ON e.pack_id = b.pack_id) y ON y.pack_id = x.pack_id AND y.path = x.path),
g AS (SELECT pack_id, side, sum((side IN ('c', 'm'))::INT) OVER (PARTITION BY pack_id ORDER BY path ROWS UNBOUNDED PRECEDING) AS gap FROM k),
h AS (SELECT pack_id, count(DISTINCT gap) FILTER (side IN ('a', 'd')) + count(*) FILTER (side = 'm') AS hunks FROM g GROUP BY pack_id)
SELECT pack_id, (h.hunks + (b.base_entries <> c.entries)::INT)::INTEGER AS hunks, c.entries, c.content_bytes, c.pack_bytes, c.contents_md5 FROM b JOIN c USING (pack_id) JOIN h USING (pack_id)
""")
def pack_edits(spark, sf_dir):
    """Each pack derived from the one of the block before, file by file, and parsed again after its script."""
    packs = stored(pack_tables(spark, sf_dir), "packs")
    before = packs.select("source", (F.col("block") + 1).alias("block"), F.col("pack").alias("base"))
    pairs = stored(packs.select("source", "block", "pack_id", F.col("pack").alias("child")).join(before, ["source", "block"]).select("pack_id", "base", "child"), "pairs")
    scripts = stored(corpus.derived(pairs, "pack_id").select("pack_id", "script", states.apply_script("base", "script").alias("made")), "scripts")
    return contents(corpus.entries(scripts, "pack_id", "made"), "pack_id").join(scripts.select("pack_id", F.size("script").alias("hunks")), "pack_id").select("pack_id", "hunks", "entries", "content_bytes", "pack_bytes", "contents_md5")


@query(r"""
WITH n AS (SELECT c_custkey, CASE c_custkey % 10 WHEN 0 THEN '# comment' WHEN 1 THEN '   ' ELSE c_name || chr(9) || 'base/' || c_custkey || chr(9) || '/abs/' || c_custkey || chr(9) || c_mktsegment || '  ' END AS line FROM customer)
SELECT split_part(rtrim(line), chr(9), 1) AS case_id, '/root/' || split_part(rtrim(line), chr(9), 2) AS base_path, split_part(rtrim(line), chr(9), 3) AS child_path FROM n WHERE c_custkey % 10 > 1
""")
def manifest_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    line = F.when(F.col("c_custkey") % 10 == 0, "# comment").when(F.col("c_custkey") % 10 == 1, "   ").otherwise(F.concat(F.concat_ws("\t", "c_name", F.concat(F.lit("base/"), key), F.concat(F.lit("/abs/"), key), "c_mktsegment"), F.lit("  ")))
    return manifests.parsed(rows.select(line.alias("value"), F.col("c_custkey").alias("n")), number="n", root="/root")


@query(f"""
WITH {DOCS}, c AS (SELECT doc_id, source || '/' || doc_id AS case_id, n, least(4096, n)::BIGINT AS read_len FROM d),
h AS (SELECT *, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(case_id) + 1), lambda i: ascii(case_id[i])::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS hash FROM c)
SELECT case_id, read_len, CASE WHEN read_len = 0 THEN 0 ELSE hash % (n - read_len + 1)::UHUGEINT END::BIGINT AS read_start FROM h
""")
def read_offsets(spark, sf_dir):
    rows = snapshots(spark, sf_dir).select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("case_id"), F.lit(b"").alias("base"), F.col("state").alias("child"), F.array().cast(f"array<{states.EDIT}>").alias("script"))
    return corpus.cases(rows, "case_id").select("case_id", "read_len", "read_start")


# -- reports --------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (k = (n - 1) * 50 // 100) AS p50, max(value) FILTER (k = (n - 1) * 95 // 100) AS p95, max(value) FILTER (k = (n - 1) * 99 // 100) AS p99 FROM r GROUP BY event_type
""")
def percentile_summary(spark, sf_dir):
    return report.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("""
WITH s AS (SELECT l_returnflag AS name, sum(l_quantity)::BIGINT AS growth, max(l_partkey) AS edit_p95, max(l_suppkey) AS read_p95 FROM lineitem GROUP BY l_returnflag), p(l, r) AS (VALUES ('A', 'N'), ('N', 'R'), ('A', 'R'))
SELECT l AS left_name, r AS right_name, a.growth AS left_growth, b.growth AS right_growth, CASE WHEN b.growth > 0 THEN a.growth / b.growth END AS growth_ratio, a.edit_p95 / greatest(b.edit_p95, 1) AS edit_ratio, a.read_p95 / greatest(b.read_p95, 1) AS read_ratio
FROM p JOIN s a ON a.name = l JOIN s b ON b.name = r
""")
def pair_ratios(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(F.sum("l_quantity").cast("long").alias("growth"), F.max("l_partkey").alias("edit_p95"), F.max("l_suppkey").alias("read_p95"))
    return report.compared(rows, "name", [("A", "N"), ("N", "R"), ("A", "R")]).select("left_name", "right_name", "left_growth", "right_growth", "growth_ratio", "edit_ratio", "read_ratio")


@query("""
WITH t AS (SELECT source, count(*) AS total FROM documents GROUP BY source), c AS (SELECT *, least(16, total) AS k FROM t)
SELECT source, total, i AS sample, CASE WHEN i + 1 = k THEN total - 1 ELSE i * (total - 1) // greatest(k - 1, 1) END AS version FROM c, LATERAL (SELECT unnest(range(0, k)) AS i)
""")
def sample_indices(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("total"))
    rows = rows.select("source", "total", F.posexplode(versions.sample_indices(F.col("total"), 16)).alias("sample", "version"))
    return rows.withColumn("sample", F.col("sample").cast("long"))


@query(f"WITH {GRAPH} SELECT count(*) AS versions, 0::BIGINT AS mismatches FROM t")
def equivalence(spark, sf_dir):
    """States replayed from edits against states read whole from piece tables and states put together from stored chunks."""
    t = graph(spark, sf_dir)
    manifest, chunks = dedup.replayed_chunks(t["version"], t["edit"], t["base"], 256)
    own = stored(manifest.select("version_id", "group", "at", "len", F.col("state_digest").alias("digest")), "digests")
    store = stored(dedup.grouped_store(chunks), "store")
    chunked = stored(dedup.grouped_states(manifest, store, "version_id", digests=True), "digests")
    dropped(store, manifest)  # each representation goes when its digests are there
    piece, buffers = pieces.piece_tables(t["version"], t["edit"], t["base"])
    read = stored(pieces.whole(own, piece, buffers, digests=True), "digests")
    dropped(piece, buffers)
    wrong = versions.differing(own, read).union(versions.differing(own, chunked)).agg(F.count("*").alias("mismatches")).withColumn("k", F.lit(0))
    return own.agg(F.count("*").alias("versions")).withColumn("k", F.lit(0)).join(wrong, "k").select("versions", "mismatches")


@query("""SELECT lang, count(*) AS snapshots, sum(octet_length(encode(text)))::DECIMAL(38, 0)::VARCHAR AS logical_bytes, round(sum(octet_length(encode(text))) / 1048576, 3) AS mib, round(sum(octet_length(encode(text))) / 1000, 3) AS thousands FROM documents GROUP BY lang""")
def logical_bytes(spark, sf_dir):
    size = F.octet_length("text")
    total = F.sum(size.cast("decimal(38,0)"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("snapshots"), total.cast("string").alias("logical_bytes"), report.mib(total.cast("double")).alias("mib"), report.micros(total.cast("double")).alias("thousands"))


# -- preparation ----------------------------------------------------------------------------


TURNS = "r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS turn, min(doc_id) OVER (PARTITION BY source) AS first FROM documents), o AS (SELECT *, row_number() OVER (ORDER BY turn, first) - 1 AS place FROM r)"


@query(f"WITH {TURNS} SELECT doc_id, source, turn, place FROM o")
def round_robin(spark, sf_dir):
    rows = prepare.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")
    return rows.select("doc_id", "source", "turn", "place")


@query(f"WITH {TURNS} SELECT doc_id, source FROM o WHERE place >= 30 AND place < 90")
def round_robin_page(spark, sf_dir):
    """60 rows from place 30 on: the page is the operator."""
    return prepare.selected(table(spark, sf_dir, "documents").select("doc_id", "source"), "round-robin", "source", "doc_id", 30, 60)


@query(r"""
WITH s AS (SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS name, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[./]+|[./]+$', '', 'g') AS c FROM pages)
SELECT page_id, name, substring(CASE WHEN c = '' THEN 'case' ELSE c END, 1, 120) AS component FROM s
""")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", states.safe_name("url").alias("name"), states.safe_component("url").alias("component"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY encode(c_name), c_custkey) - 1 AS place FROM customer")
def path_order(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").cast("binary").alias("path"))
    return ranked(prepare.by_path(rows, "path"), [], ["path", "c_custkey"], "place").select("c_custkey", "place")


@query("SELECT source, min(doc_id) AS first FROM documents GROUP BY source")
def distinct_sources(spark, sf_dir):
    return prepare.distinct_in_order(table(spark, sf_dir, "documents"), "source", "doc_id")


# -- storage floors and checkpoints ---------------------------------------------------------


@query(f"WITH {NEIGHBOURS} SELECT count(*) AS cases, sum(octet_length(base))::BIGINT AS base_bytes, sum(octet_length(base) + octet_length(child))::BIGINT AS final_bytes, sum(octet_length(child)) / count(*) AS growth_per_case FROM q")
def raw_sizes(spark, sf_dir):
    rows = neighbours(spark, sf_dir).agg(F.count("*").alias("cases"), F.sum(states.state_len("base")).alias("base_bytes"), F.sum(states.state_len("base") + states.state_len("child")).alias("final_bytes"))
    return rows.withColumn("growth_per_case", dedup.per_branch(F.col("final_bytes") - F.col("base_bytes"), F.col("cases")))


@query()
def compressed_sizes(spark, sf_dir):
    """Independent compression against compression with the base as dictionary."""
    rows = neighbours(spark, sf_dir).select(native.zstd_size(3)("base").alias("base"), native.zstd_size(3)("child").alias("child"), native.delta_size()("base", "child").alias("delta"))
    one = rows.agg(F.count("*").alias("cases"), F.sum("base").alias("base_bytes"), F.sum("child").alias("independent_growth"), F.sum("delta").alias("delta_growth"))
    return one.withColumn("delta_ratio", report.ratio(F.col("delta_growth"), F.col("independent_growth")))


@query(f"""
WITH {GRAPH} SELECT count(*) AS versions, sum(octet_length(state))::BIGINT AS full_bytes, (SELECT sum(16 + octet_length(ins)) FROM g WHERE parent_id IS NOT NULL)::BIGINT AS log_bytes, coalesce(sum(octet_length(state)) FILTER (depth % 4 = 0), 0)::BIGINT AS snapshot_bytes, 0::BIGINT AS mismatches FROM t
""")
def checkpoint_layouts(spark, sf_dir):
    """Full states against a delta log with a full state every four levels, restored and compared."""
    t = graph(spark, sf_dir)
    version = stored(t["version"], "version")
    flat = stored(versions.replayed(version, t["edit"], t["base"]), "flat")
    log, kept = checkpoints.delta_log(version, t["edit"], flat, every=4)
    log = stored(log, "log")
    one = lambda df: df.withColumn("k", F.lit(0))
    sizes = stored(one(checkpoints.sizes(flat, log, kept)).join(one(flat.agg(F.count("*").alias("versions"))), "k"), "sizes")
    full = stored(versions.digests(flat), "digests")
    back = checkpoints.restored(version, log, kept)
    dropped(flat)  # its sizes, its digests and the snapshots cut from it are stored
    wrong = one(versions.differing(full, versions.digests(back)).agg(F.count("*").alias("mismatches")))
    return sizes.join(wrong, "k").select("versions", "full_bytes", "log_bytes", "snapshot_bytes", "mismatches")


@query(f"WITH {EDITED} SELECT doc_id, (16 + octet_length(ins))::BIGINT AS encoded_len, start, delete_len::BIGINT AS delete_len, md5(state[1:start] || ins || state[start + delete_len + 1 : n]) AS child_md5 FROM e")
def encoded_edits(spark, sf_dir):
    """Edits through their 16-byte head and back, then applied."""
    rows = edited(spark, sf_dir).withColumn("code", native.encoded_edit("start", "delete_len", "insert")).withColumn("e", native.decoded_edit("code"))
    return rows.select("doc_id", states.state_len("code").alias("encoded_len"), "e.start", "e.delete_len", F.md5(states.splice("state", "e.start", "e.delete_len", "e.insert", strict=True)).alias("child_md5"))


@query("SELECT coalesce(sum(s_acctbal::BIGINT), 0)::BIGINT AS bytes FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_regionkey = 1)")
def relation_bytes(spark, sf_dir):
    """Sizes of files joined to the relations that own them."""
    nation = table(spark, sf_dir, "nation")
    names = [r[0] for r in nation.where("n_regionkey = 1").select("n_name").collect()]  # a fixed table of 25 rows
    files = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("relation_id"), F.rint("s_acctbal").cast("long").alias("size"))  # halves to the even neighbour, as in SQL
    return checkpoints.relation_bytes(files, nation.select(F.col("n_nationkey").alias("relation_id"), F.col("n_name").alias("name")), names)


@query("SELECT 'documents' AS relation, count(*) AS rows FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'missing', 0")
def row_counts(spark, sf_dir):
    for name in ("documents", "conversations"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"fs_{name}")
    found = checkpoints.row_counts(spark, ["fs_documents", "fs_conversations", "fs_missing"])
    return spark.createDataFrame([(k[3:], n) for k, n in found.items()], "relation string, rows long")


@query(f"WITH {GRAPH} SELECT 0::BIGINT AS mismatches, count(*) AS versions FROM t")
def reopen_verify(spark, sf_dir):
    """States written, read by a fresh session, and compared with an independent replay."""
    t = graph(spark, sf_dir)
    flat = versions.replayed(t["version"], t["edit"], t["base"])
    path = new_path(spark, "reopened")
    wrong = checkpoints.reopened_mismatches(spark, path, flat).agg(F.count("*").alias("mismatches")).withColumn("k", F.lit(0))
    return wrong.join(spark.read.parquet(path).agg(F.count("*").alias("versions")).withColumn("k", F.lit(0)), "k").select("mismatches", "versions")


@query()
def workload_report(spark, sf_dir):
    """A small seeded workload of each family through all representations; independent of the tables."""
    out = []
    for kind in Kind:
        found = runner.run_workload(spark, Config(kind, branches=32, base_bytes=64 << 10, max_edit_bytes=512, read_bytes=1024, seed=11), average=1024)
        out += [(found["kind"], r["name"], r["base_bytes"], r["final_bytes"], r["growth_per_branch"], found["read_checksum"]) for r in found["reports"]]
    return spark.createDataFrame(out, "kind string, name string, base_bytes long, final_bytes long, growth_per_branch double, read_checksum string")


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in FOUND.items() if sql}
