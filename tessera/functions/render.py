"""Cell rendering for export (P5) and SQL literal rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column types whose SQL literals are written unquoted.
UNQUOTED_SQL_TYPES = (
    "smallint", "integer", "int", "int2", "int4", "int8", "bigint",
    "numeric", "decimal", "real", "double precision", "float", "float4", "float8",
    "boolean", "bool", "serial", "bigserial", "smallserial",
)


def render_timestamp(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss[.ffffff] +0000 UTC`` with trailing fraction zeros trimmed.

    Rendered in the session time zone, which the library sets to UTC, so the
    offset is ``+0000``. Timestamps without time zone render their wall time.
    """
    frac = F.regexp_replace(F.concat(F.lit("."), F.date_format(ts, "SSSSSS")), r"\.?0+$", "")
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), frac, F.lit(" "), F.date_format(ts, "xx"), F.lit(" UTC"))


def render_cell(c: Column, dtype: T.DataType) -> Column:
    """P5: export text of one cell: NULL -> ``NULL``; timestamps/dates in the export form;
    booleans ``true``/``false``; everything else its plain text."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        v = render_timestamp(c)
    elif isinstance(dtype, T.DateType):
        v = render_timestamp(c.cast("timestamp"))
    elif isinstance(dtype, T.BooleanType):
        v = F.when(c.isNull(), F.lit(None)).when(c, F.lit("true")).otherwise(F.lit("false"))
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        v = F.to_json(c)
    else:
        v = c.cast("string")
    return F.coalesce(v, F.lit("NULL"))


def render_cells(df: DataFrame) -> DataFrame:
    """P5 over a whole table: every column becomes its export text."""
    return df.select(*[render_cell(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def quote_ident(name: str) -> str:
    """``"name"`` with embedded double quotes doubled."""
    return '"' + name.replace('"', '""') + '"'


def sql_literal(cell: Column, col_type: str) -> Column:
    """SQL literal of an export cell: ``NULL`` stays NULL; numeric/boolean types unquoted
    (empty -> NULL); everything else single-quoted with quotes doubled."""
    unquoted = col_type.strip().lower() in UNQUOTED_SQL_TYPES
    quoted = F.concat(F.lit("'"), F.replace(cell, F.lit("'"), F.lit("''")), F.lit("'"))
    if unquoted:
        body = F.when(cell == "", F.lit("NULL")).otherwise(cell)
    else:
        body = quoted
    return F.when(cell.isNull() | (cell == "NULL"), F.lit("NULL")).otherwise(body)
