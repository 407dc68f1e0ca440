"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from forkscope.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def alike(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        columns = want.columns
        assert sorted(columns) == sorted(df.columns)
        at = [columns.index(c) for c in df.columns]
        expected = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
        assert len(rows) == len(expected)
        assert all(alike(x, y) for a, b in zip(rows, expected) for x, y in zip(a, b))


def test_halves_in_relation_bytes(spark, tmp_path):
    nation = spark.createDataFrame([(1, "ARGENTINA", 1), (8, "INDIA", 2)], "n_nationkey int, n_name string, n_regionkey int")
    supplier = spark.createDataFrame([(i, 1 if i else 8, v) for i, v in enumerate([9.5, 0.5, 2.5, -2.5, 7.5, -0.5, 1.49, None])], "s_suppkey long, s_nationkey int, s_acctbal double")
    db = duckdb.connect()
    for name, df in (("nation", nation), ("supplier", supplier)):
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in catalogue.queries()["relation_bytes"](spark, str(tmp_path)).collect()]
    assert got == db.sql(catalogue.oracle_sql()["relation_bytes"]).fetchall() == [(0 + 2 - 2 + 8 + 0 + 1,)]


def test_streamed_sizes(spark, tmp_path):
    from forkscope.streaming import edit_log

    schema = spark.read.parquet(f"{SF}/conversations.parquet").schema
    spark.read.parquet(f"{SF}/conversations.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = edit_log.running_sizes(turns).writeStream.outputMode("complete").format("memory").queryName("sizes").start()
    q.processAllAvailable()
    q.stop()
    got = {r.conv_id: (r.turns, r.len) for r in spark.table("sizes").collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        n, size = want.get(r.conv_id, (0, 0))
        want[r.conv_id] = n + 1, size + len((r.text or "").encode())
    assert got == want


def test_command_line():
    from forkscope.cli import arguments

    a = arguments(["--base-mib", "1", "--base-kib", "8", "--seed", "0x10"])
    assert a.base_bytes == 8192 and a.seed == 16
    assert arguments([]).base_bytes == 2 << 20
    b = arguments(["--leaf-bytes", "512", "--verify-samples", "3", "--avg-chunk-bytes", "128"])
    assert (b.leaf_bytes, b.verify_samples, b.avg_chunk_bytes) == (512, 3, 128) and (a.leaf_bytes, a.verify_samples, a.avg_chunk_bytes) == (4096, 16, 4096)
    for wrong in (["--avg-chunk-bytes", "63"], ["--leaf-bytes", "0"]):
        with pytest.raises(SystemExit):
            arguments(wrong)
