"""Column functions over byte states (BINARY) and splice edits (start, delete_len, insert)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDIT = "struct<start:bigint, delete_len:bigint, insert:binary>"
OUT_OF_BOUNDS, OVERFLOW = "OutOfBounds", "LengthOverflow"
LARGEST = 2**63 - 1


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def state_len(state) -> Column:
    return F.octet_length(_c(state)).cast("long")


def range_error(n, start, size) -> Column:
    """Null for a range inside n bytes, else the error's class. Negative numbers are out of bounds."""
    n, start, size = (_c(x).cast("long") for x in (n, start, size))
    over = (start > 0) & (size > 0) & (start > F.lit(LARGEST) - size)
    return F.when(over, OVERFLOW).when((start < 0) | (size < 0) | (start > n) | (size > n - start), OUT_OF_BOUNDS)


def error_message(n, start, size) -> Column:
    kind = range_error(n, start, size)
    text = F.concat(F.lit("edit/range out of bounds: len="), _c(n).cast("string"), F.lit(", start="), _c(start).cast("string"), F.lit(", delete_len="), _c(size).cast("string"))
    return F.when(kind == OVERFLOW, "state length arithmetic overflow").when(kind.isNotNull(), text)


def output_len(n, start, delete_len, insert) -> Column:
    """Null where the edit is invalid."""
    return F.when(range_error(n, start, delete_len).isNull(), _c(n).cast("long") - _c(delete_len) + state_len(insert))


def splice(state, start, delete_len, insert, strict: bool = False) -> Column:
    """prefix, insert, suffix. An invalid edit gives null, or fails the query if strict: overlay by itself would pass it over."""
    state, start, delete_len = _c(state), _c(start), _c(delete_len)
    done = F.overlay(state, _c(insert), (start + 1).cast("int"), delete_len.cast("int"))
    good = range_error(F.octet_length(state), start, delete_len).isNull()
    bad = F.raise_error(error_message(F.octet_length(state), start, delete_len)).cast("binary") if strict else F.lit(None).cast("binary")
    return F.when(good, done).otherwise(bad)


def read_range(state, start, size) -> Column:
    """Null where the range is not inside the state; empty for size 0."""
    state = _c(state)
    return F.when(range_error(F.octet_length(state), start, size).isNull(), F.substring(state, (_c(start) + 1).cast("int"), _c(size).cast("int")))


def apply_script(state, edits) -> Column:
    """Edits (array of EDIT) applied one after another; null from the first invalid one on."""
    return F.aggregate(_c(edits), _c(state), lambda a, e: splice(a, e["start"], e["delete_len"], e["insert"]))


def edit_kind(start, delete_len, insert, n) -> Column:
    size = F.octet_length(_c(insert))
    return F.when((_c(delete_len) == 0) & (size == 0), "none").when((_c(delete_len) == 0) & (_c(start) == _c(n)), "append").when(_c(delete_len) == 0, "insert").when(size == 0, "delete").otherwise("replace")


def repeated(template, size) -> Column:
    """template over and over, cut to size bytes."""
    template = _c(template)
    times = F.ceil(_c(size) / F.greatest(F.octet_length(template), F.lit(1))).cast("int")
    return F.substring(F.repeat(template, times).cast("binary"), F.lit(1), _c(size).cast("int"))


def safe_name(value) -> Column:
    """Letters, digits and . _ - stay, anything else becomes an underscore."""
    return F.regexp_replace(_c(value), r"[^\p{L}\p{N}._-]", "_")


def safe_component(value) -> Column:
    """Runs of other characters become one underscore; dots and slashes at the ends go; 120 characters at most; `case` if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(_c(value), r"[^A-Za-z0-9._-]+", "_"), r"^[./]+|[./]+$", "")
    return F.substring(F.when(clean == "", "case").otherwise(clean), 1, 120)
