"""Catalog text parsers as column expressions (P11, P12) and id hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def strip_ws(c: Column) -> Column:
    """Leading and trailing whitespace removed, Unicode spaces, tabs and newlines included
    (``F.trim`` removes only the space character)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def allowed_values(check_clause: Column) -> Column:
    """Quoted strings of the first value list of a CHECK clause, ``IN (...)`` or ``ANY (ARRAY[...])``; null when the
    clause has none or the list has no quoted value.

    A clause splits at its quotes into code (every second piece) and values (the pieces between). The list is looked for
    in the code alone, with a quote mark standing for each value, so words and brackets inside values mean nothing: the
    marks between the opening bracket and the next closing one are the list's values, the marks before it count those of
    earlier text."""
    pieces = F.split(check_clause, "'")
    every_second = lambda parity: F.filter(pieces, lambda _, i: i % 2 == parity)
    code = F.lower(F.array_join(every_second(0), "'"))
    code = F.regexp_replace(code, r"\s*([(\[])\s*", "$1")  # no space around opening brackets
    marks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("'"), F.lit("")))
    word_in, any_array = F.regexp_instr(code, F.lit(r"\bin\(")), F.instr(code, "any(array[")
    is_in = (word_in > 0) & ((any_array == 0) | (word_in < any_array))
    begin = F.when(is_in, word_in + len("in(")).when(any_array > 0, any_array + len("any(array["))
    rest = F.substring(code, begin, F.length(code))
    size = F.when(is_in, F.instr(rest, ")")).otherwise(F.instr(rest, "]")) - 1
    count = F.when(size > 0, marks(F.substring(rest, F.lit(1), size)))
    return F.when(count > 0, F.slice(every_second(1), marks(F.substring(code, F.lit(1), begin - 1)) + 1, F.greatest(count, F.lit(0))))


def enum_values(col_type: Column) -> Column:
    """``enum('a','b')`` -> ``[a, b]`` (comma split, trimmed, quotes stripped, empties
    dropped); null for a type that is not an enum."""
    lower = F.lower(col_type)
    start, end = F.instr(col_type, "("), F.length(col_type) - F.instr(F.reverse(col_type), ")") + 1
    ok = lower.startswith("enum") & (F.instr(col_type, "(") > 0) & (F.instr(col_type, ")") > 0) & (end > start)
    inner = F.substring(col_type, start + 1, end - start - 1)
    parts = F.transform(F.split(inner, ",", -1), lambda p: F.regexp_replace(strip_ws(p), r"^'+|'+$", ""))
    vals = F.filter(parts, lambda v: v != "")
    return F.when(ok, F.when(F.size(vals) > 0, vals))


def synthetic_enum_name(table: Column, column: Column) -> Column:
    """Name given to a MySQL inline enum: ``<table>_<column>``."""
    return F.concat(table, F.lit("_"), column)


def test_id(file: Column, title: Column, project: Column) -> Column:
    """sha1 of file, title and project joined by NUL."""
    return F.sha1(F.concat_ws("\u0000", F.coalesce(file, F.lit("")), F.coalesce(title, F.lit("")),
                              F.coalesce(project, F.lit(""))))


def content_hash(text: Column) -> Column:
    """sha1 of a test's content (the usage event's ``testHash``)."""
    return F.sha1(F.coalesce(text, F.lit("")))
