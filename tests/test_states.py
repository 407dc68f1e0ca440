import pytest
from pyspark.sql import functions as F

from forkscope.functions import states

CASES = [(b"abcdefghij", 3, 0, b"XYZ", b"abcXYZdefghij"), (b"abcdefghij", 2, 4, b"", b"abghij"), (b"abcdefghij", 2, 4, b"Q", b"abQghij"), (b"", 0, 0, b"", b""), (b"", 0, 0, b"x", b"x"), (b"ab", 2, 0, b"c", b"abc"), (bytes(range(256)), 250, 6, b"\0\xff", bytes(range(250)) + b"\0\xff"), (b"abc", 5, 2, b"", None), (b"abc", 2, 2, b"", None), (b"abc", -1, 1, b"", None), (b"abc", 1, -1, b"", None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(CASES, "s binary, start long, d long, i binary, want binary")


def test_splice(rows):
    for r in rows.withColumn("got", states.splice("s", "start", "d", "i")).withColumn("n", states.output_len(F.octet_length("s"), "start", "d", "i")).collect():
        assert r.got == r.want
        assert r.n == (None if r.want is None else len(r.want))


def test_strict_splice_fails(rows):
    assert rows.where("want IS NOT NULL").select(states.splice("s", "start", "d", "i", strict=True)).collect()
    with pytest.raises(Exception, match="out of bounds: len=3, start=5, delete_len=2"):
        rows.where("start = 5").select(states.splice("s", "start", "d", "i", strict=True)).collect()


def test_errors(spark):
    df = spark.createDataFrame([(3, 5, 2), (3, 1, 2), (3, 2**62, 2**62 + 5), (3, 3, 0), (3, 4, 0)], "n long, s long, d long")
    got = [r[0] for r in df.select(states.range_error("n", "s", "d")).collect()]
    assert got == ["OutOfBounds", None, "LengthOverflow", None, "OutOfBounds"]


def test_range_read(spark):
    df = spark.createDataFrame([(b"hello", 1, 3), (b"hello", 5, 0), (b"hello", 0, 5), (b"", 0, 0), (b"hello", 3, 3)], "s binary, a long, n long")
    assert [r[0] for r in df.select(states.read_range("s", "a", "n")).collect()] == [b"ell", b"", b"hello", b"", None]


def test_script(spark):
    df = spark.createDataFrame([(b"abc", [(0, 1, b"X"), (3, 0, b"!"), (1, 2, b"")])], f"s binary, e array<{states.EDIT}>")
    assert df.select(states.apply_script("s", "e")).first()[0] == b"X!"


def test_kinds_names_and_templates(spark):
    df = spark.createDataFrame([(3, 0, b"x", 3), (1, 0, b"x", 3), (1, 1, b"", 3), (1, 1, b"x", 3), (1, 0, b"", 3)], "s long, d long, i binary, n long")
    assert [r[0] for r in df.select(states.edit_kind("s", "d", "i", "n")).collect()] == ["append", "insert", "delete", "replace", "none"]
    names = spark.createDataFrame([("a/b c!é",), ("../x//y..",), ("///",), ("x" * 200,)], "v string")
    assert [tuple(r) for r in names.select(states.safe_name("v"), states.safe_component("v")).collect()] == [("a_b_c_é", "a_b_c_"), (".._x__y..", "_x_y"), ("___", "_"), ("x" * 200, "x" * 120)]
    t = spark.createDataFrame([("abc", 7), ("abc", 0), ("abc", 3)], "t string, n int")
    assert [r[0] for r in t.select(states.repeated("t", "n")).collect()] == [b"abcabca", b"", b"abc"]
