"""Typed coercion of snapshot text cells.

A snapshot cell is text. Its column's database type string selects a family
by equality, prefix or substring tests, in the order the source applies them
(trap Q7 keeps those classes: ``interval`` and ``point`` fall in the integer
family). Spark columns are typed, so a cell that the source would have passed
through unparsed becomes NULL in the typed column and is reported in a
``_rejects`` array (trap Q1) built in the same pass.

All rules are column expressions (``when`` chains, ``rlike`` guards,
``try_cast`` / ``try_to_timestamp``); no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.parse import strip_ws

# Cell tokens and type names of the coercion rules.
NULL_TOKENS = ("NULL", "null")
PG_TRUE, PG_FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
MYSQL_TRUE, MYSQL_FALSE = ("true", "t", "yes", "1"), ("false", "f", "no", "0")
PG_TEXT_TYPES, PG_TEXT_PREFIXES = ("text", "char"), ("character varying", "varchar", "char(")
MYSQL_TEXT_TYPES, MYSQL_TEXT_PREFIXES = ("text", "tinytext", "mediumtext", "longtext", "char"), ("varchar", "char(")
MYSQL_BOOL_TYPES = ("tinyint", "bool", "boolean")

# ``\z``, not ``$``: in Java ``$`` also matches before a final newline, which Go's parsers reject
_INT_RE = r"^[+-]?[0-9]+\z"
_FLOAT_RE = (r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?"
             r"|[nN][aA][nN])\z")
# Export form: "2006-01-02 15:04:05.999999 -0700 UTC"; RFC 3339; plain datetime; date.
_TS_EXPORT = "yyyy-MM-dd HH:mm:ss[.SSSSSS] xx 'UTC'"
_TS_RFC3339 = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX"
# a fraction after the seconds is accepted even where the layout has none, as Go's parser does
_TS_PLAIN = "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]"
_DATE = "yyyy-MM-dd"


def _ts(s: Column, fmt: str) -> Column:
    return F.try_to_timestamp(s, F.lit(fmt))


def _is_null_token(s: Column) -> Column:
    return s.isNull() | s.isin(*NULL_TOKENS)


# ----------------------------------------------------------------------- P3

# Strict JSON parsing: Spark's parsers stop after the first complete value and ignore what follows
# (``{"a":1} x`` parses), and accept single quotes and NaN by default. A string is valid JSON here
# when ``[<s>,"~json-end~"]`` parses as exactly two elements ending with the sentinel.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_SENTINEL = "~json-end~"


def json_valid(s: Column) -> Column:
    """True when ``s`` is one complete JSON value (surrounding whitespace allowed), as Go decodes it."""
    arr = F.from_json(F.concat(F.lit("["), s, F.lit(f',"{_SENTINEL}"]')), "array<string>", _STRICT)
    return F.coalesce((F.size(arr) == 2) & (F.element_at(arr, 2) == F.lit(_SENTINEL)), F.lit(False))


def _json_ok(s: Column) -> Column:
    return json_valid(s)


def _fix_simple_json(s: Column) -> Column:
    """Swap every ``'`` for ``"`` and close unquoted keys: a ``:`` outside double quotes
    whose previous non-blank character is not ``"``, ``}`` or ``]`` becomes ``":``."""
    swapped = F.translate(s, "'", '"')
    segs = F.split(swapped, '"', -1)
    fixed = F.transform(segs, lambda seg, i: F.when(
        i % 2 == 0, F.regexp_replace(seg, r'([^ \t"}\]])([ \t]*):', '$1$2":')).otherwise(seg))
    return F.array_join(fixed, '"')


def repair_json(s: Column) -> Column:
    """Valid JSON unchanged; else single quotes swapped when no double quote is present;
    else all quotes swapped and unquoted keys closed; still invalid -> original text.

    (Trap Q20: closing only the key's end quote keeps ``{a:1}`` invalid, so the
    original is kept, as in the source.)
    """
    first = F.when(F.instr(s, "'") > 0, F.when(F.instr(s, '"') == 0, F.translate(s, "'", '"')).otherwise(s)).otherwise(s)
    second = _fix_simple_json(first)
    return (F.when(_json_ok(s), s)
            .when(_json_ok(first), first)
            .when(_json_ok(second), second)
            .otherwise(s))


# ----------------------------------------------------------------------- P4

def _split_outside_quotes(inner: Column) -> Column:
    """Comma split that ignores commas inside double quotes; elements trimmed; a final empty
    (untrimmed) element dropped."""
    segs = F.split(inner, '"', -1)
    protected = F.array_join(F.transform(segs, lambda seg, i: F.when(i % 2 == 1, F.translate(seg, ",", "\u0001"))
                                         .otherwise(seg)), '"')
    parts = F.split(protected, ",", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda p: strip_ws(F.translate(p, "\u0001", ",")))


def to_pg_array(s: Column) -> Column:
    """JSON array text -> PostgreSQL array literal.

    ``{...}`` is kept; ``[...]`` (single quotes swapped when no double quote)
    parsed as JSON renders strings as ``"..."`` with ``\\"`` escapes, nulls as
    ``NULL`` and other values as their JSON text (trap Q20 fixed: no ``<nil>``,
    no ``1e+06``); unparseable brackets fall back to a quote-aware comma split.
    Anything else is returned unchanged.
    """
    bracketed = (s.startswith("[") & s.endswith("]")) | (s.startswith("{") & s.endswith("}"))
    fixed = F.when((F.instr(s, "'") > 0) & (F.instr(s, '"') == 0), F.translate(s, "'", '"')).otherwise(s)
    arr = F.when(json_valid(fixed), F.from_json(fixed, "array<variant>", _STRICT))

    def render(x):
        kind = F.schema_of_variant(x)
        return (F.when(F.is_variant_null(x), F.lit("NULL"))
                .when(kind == "STRING", F.concat(F.lit('"'), F.replace(F.variant_get(x, "$", "string"),
                                                                        F.lit('"'), F.lit('\\"')), F.lit('"')))
                .otherwise(F.to_json(x)))

    from_json_arr = F.concat(F.lit("{"), F.array_join(F.transform(arr, render), ","), F.lit("}"))
    inner = F.substring(s, F.lit(2), F.length(s) - 2)
    fallback = F.concat(F.lit("{"), F.array_join(_split_outside_quotes(inner), ","), F.lit("}"))
    return (F.when(~bracketed, s)
            .when(s.startswith("{"), s)
            .when(arr.isNotNull(), from_json_arr)
            .otherwise(fallback))


# ----------------------------------------------------------------------- P1 / P2

def family(col_type: str, dialect: str = "postgres") -> str:
    """Type family of a database type string (the source's rule order)."""
    t = (col_type or "").lower()
    if dialect == "postgres":
        if t in PG_TEXT_TYPES or t.startswith(PG_TEXT_PREFIXES):
            return "text"
        if t in ("json", "jsonb"):
            return "json"
        if t.startswith("array") or t.endswith("[]"):
            return "array"
        if "time" in t or "date" in t:
            return "date" if t == "date" else "time"
        if t in ("boolean", "bool"):
            return "bool"
        if "int" in t or "serial" in t:
            return "int"
        if "float" in t or "numeric" in t or "decimal" in t or t in ("real", "double precision"):
            return "float"
        return "string"
    if t in MYSQL_TEXT_TYPES or t.startswith(MYSQL_TEXT_PREFIXES):
        return "text"
    if t == "json":
        return "json_raw"
    if t in MYSQL_BOOL_TYPES:
        return "tinybool"
    if "int" in t:
        return "int"
    if any(k in t for k in ("float", "double", "decimal", "numeric")):
        return "float"
    if "datetime" in t or "timestamp" in t:
        return "time_mysql"
    if t == "date":
        return "date"
    return "string"


def coerce_value(s: Column, col_type: str, dialect: str = "postgres") -> Column:
    """Typed value of one cell; NULL for null tokens, empty non-text cells and unparseable cells."""
    fam = family(col_type, dialect)
    is_text = fam == "text"
    empty_null = _is_null_token(s) | ((s == "") if not is_text else F.lit(False))
    if fam in ("text", "string", "json_raw"):
        v = s
    elif fam == "json":
        v = repair_json(s)
    elif fam == "array":
        v = to_pg_array(s)
    elif fam in ("time", "time_mysql"):
        tries = ([F.when(F.instr(s, "UTC") > 0, _ts(s, _TS_EXPORT))] if fam == "time" else [_ts(s, _TS_EXPORT)])
        v = F.coalesce(*tries, _ts(s, _TS_RFC3339), _ts(s, _TS_PLAIN),
                       *([_ts(s, _DATE)] if fam == "time" else []))
    elif fam == "date":
        # PostgreSQL: the time-family formats. MySQL (trap Q6, fixed): a date column exported in the
        # timestamp form parses back too, not only ``yyyy-MM-dd``.
        ts = F.coalesce(F.when(F.instr(s, "UTC") > 0, _ts(s, _TS_EXPORT)), _ts(s, _TS_RFC3339), _ts(s, _TS_PLAIN),
                        _ts(s, _DATE))
        v = F.to_date(ts)
    elif fam == "bool":
        lo = F.lower(s)
        v = F.when(lo.isin(*PG_TRUE), F.lit(True)).when(lo.isin(*PG_FALSE), F.lit(False))
    elif fam == "tinybool":
        lo = F.lower(s)
        v = F.when(lo.isin(*MYSQL_TRUE), F.lit(1).cast("long")).when(lo.isin(*MYSQL_FALSE), F.lit(0).cast("long"))
        if "int" in col_type.lower():  # tinyint falls through to the integer rule
            v = v.when(s.rlike(_INT_RE), s.try_cast("long"))
    elif fam == "int":
        v = F.when(s.rlike(_INT_RE), s.try_cast("long"))
    elif fam == "float":
        d = s.try_cast("double")
        # out-of-range literals (1e400) are a parse error for the source, not infinity
        v = F.when(s.rlike(_FLOAT_RE) & ((F.abs(d) != F.lit(float("inf"))) | s.rlike("(?i)inf")), d)
    else:
        v = s
    return F.when(empty_null, F.lit(None)).otherwise(v)


def coerce_table(df: DataFrame, types: Mapping[str, str], dialect: str = "postgres",
                 keep: list[str] | None = None) -> DataFrame:
    """Type every column of a text snapshot table in one projection.

    ``types`` maps column -> database type string. Columns not in ``types``
    stay text. The result has the typed columns plus ``_rejects``:
    ``array<struct<column_name, raw>>`` of cells that were not null tokens but
    did not parse.
    """
    keep = keep or []
    sel, rej = [], []
    for c in df.columns:
        if c in keep or c not in types:
            sel.append(F.col(c))
            continue
        raw = F.col(c)
        val = coerce_value(raw, types[c], dialect)
        sel.append(val.alias(c))
        fam = family(types[c], dialect)
        if fam not in ("text", "string", "json", "json_raw", "array"):
            bad = ~_is_null_token(raw) & (raw != "") & val.isNull()
            rej.append(F.when(bad, F.struct(F.lit(c).alias("column_name"), raw.alias("raw"))))
    rejects = (F.filter(F.array(*rej), lambda x: x.isNotNull()) if rej
               else F.array().cast("array<struct<column_name:string,raw:string>>"))
    return df.select(*sel, rejects.alias("_rejects"))


def split_rejects(typed: DataFrame, key_cols: list[str], table: str) -> tuple[DataFrame, DataFrame]:
    """(clean typed table, rejects(table_name, key..., column_name, raw))."""
    rejects = (typed.where(F.size("_rejects") > 0)
               .select(*key_cols, F.explode("_rejects").alias("r"))
               .select(F.lit(table).alias("table_name"), *key_cols, "r.column_name", "r.raw"))
    return typed.drop("_rejects"), rejects
