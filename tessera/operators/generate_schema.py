"""Generated data for a whole schema (G1): every table of a catalog, with its keys, references and value domains.

Each value is a function of its table, column and row number, and a reference is the parent's key at a row number
that the child's row picks. So tables need neither each other nor a shuffle: a table of any size is one
``range`` with column expressions, the same on every run.

* A reference picks a parent's row by a hash. Where it must be unique (one to one, or part of a composite key)
  row numbers go through a keyed permutation of the parent's rows, so no row is picked twice.
* The permutation works on any number of rows: in each round a number and its mirror image (round key minus number,
  modulo the size) stay or change places, by a bit of a hash of the larger of the two.
* A table that references itself picks a smaller row number; its first row has none (itself, if the column must be set).
* Columns with an enum or allowed values draw from them; nullable columns without a key are null in one row of ten.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.operators.generate import uuid_from_index

ROUNDS = 10
_EPOCH = 1_704_067_200  # 2024-01-01


def _salt(*names: object) -> int:
    return zlib.crc32("\0".join(map(str, names)).encode())


def permuted(x: Column, n: int, key: int) -> Column:
    """A keyed permutation of 0 .. n - 1."""
    if n < 2:
        return x
    keys = F.array(*[F.lit(_salt(key, r) % n).cast("long") for r in range(ROUNDS)])

    def swap(at: Column, k: Column) -> Column:
        mirror = F.pmod(k - at, F.lit(n))
        bit = F.xxhash64(F.greatest(at, mirror), k, F.lit(key)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, mirror).otherwise(at)

    return F.aggregate(keys, x.cast("long"), swap)


class SchemaData:
    """Expressions of one schema's values. ``columns``: rows of ``schema_columns``; ``rows``: rows of each table;
    ``enums``: values by enum name."""

    def __init__(self, columns: list[Row], rows: Mapping[str, int], enums: Mapping[str, list[str]] | None = None, seed: int = 0):
        self.tables: dict[str, list[Row]] = {}
        for c in sorted(columns, key=lambda c: (c.table_name, c.ordinal)):
            self.tables.setdefault(c.table_name, []).append(c)
        self.rows, self.enums, self.seed = rows, enums or {}, seed
        self.by_name = {(c.table_name, c.column_name): c for c in columns}

    def order(self) -> list[str]:
        """Tables with parents before children; a cycle of required references is an error."""
        done: list[str] = []

        def visit(table: str, path: tuple[str, ...]) -> None:
            if table in path:
                raise ValueError(f"tables need each other: {' -> '.join([*path, table])}")
            if table not in done:
                for c in self.tables[table]:
                    if c.fk_table in self.tables and c.fk_table != table and not c.nullable:
                        visit(c.fk_table, (*path, table))
                done.append(table)

        for table in sorted(self.tables):
            visit(table, ())
        return done

    def _domain(self, c: Row) -> list[str]:
        return list(c.asDict().get("allowed_values") or []) or list(self.enums.get(c.enum_name or "", []))

    def _references(self, c: Row) -> bool:
        return c.fk_table in self.tables

    def value(self, table: str, name: str, i: Column) -> Column:
        """The column's value in row ``i`` (from 0)."""
        c = self.by_name[table, name]
        n, key = self.rows[table], _salt(self.seed, table, name)
        primary = [x for x in self.tables[table] if x.is_primary]
        single = c.is_unique or (c.is_primary and len(primary) == 1)
        if self._references(c):
            return self._reference(c, primary, single, i, n, key)
        if c.is_primary and not single:
            return self._digit(c, primary, i)
        domain = self._domain(c)
        if domain:
            if single and n > len(domain):
                raise ValueError(f"{table}.{name}: {n} unique rows of {len(domain)} values")
            at = i if single else F.pmod(F.xxhash64(i, F.lit(key)), F.lit(len(domain)))
            value = F.element_at(F.array(*map(F.lit, domain)), (at + 1).cast("int"))
        else:
            value = self._typed(c, permuted(i, n, key) if single and not c.is_primary else i, single, key)
        if c.nullable and not c.is_primary:
            value = F.when(F.pmod(F.xxhash64(i, F.lit(key + 1)), F.lit(10)) != 0, value)
        return value

    def _reference(self, c: Row, primary: list[Row], single: bool, i: Column, n: int, key: int) -> Column:
        parents = self.rows[c.fk_table]
        if c.fk_table == c.table_name:
            # a chain where it must be unique: the row before
            pick = i - 1 if single else F.pmod(F.xxhash64(i, F.lit(key)), F.greatest(i, F.lit(1)))
            own = F.lit(None) if c.nullable else self.value(c.table_name, c.fk_column, i)
            return F.when(i > 0, self.value(c.fk_table, c.fk_column, pick)).otherwise(own)
        if not parents:
            if not c.nullable and n:
                raise ValueError(f"{c.table_name}.{c.column_name}: no rows in {c.fk_table}")
            return F.lit(None).cast("string")
        if c.is_primary and len(primary) > 1:
            return self.value(c.fk_table, c.fk_column, self._digit(c, primary, i))
        if single:
            if n > parents and not c.nullable:
                raise ValueError(f"{c.table_name}.{c.column_name}: {n} unique references to {parents} rows")
            return F.when(i < parents, self.value(c.fk_table, c.fk_column, permuted(i, parents, key)))
        value = self.value(c.fk_table, c.fk_column, F.pmod(F.xxhash64(i, F.lit(key)), F.lit(parents)))
        return F.when(F.pmod(F.xxhash64(i, F.lit(key + 1)), F.lit(10)) != 0, value) if c.nullable else value

    def _digit(self, c: Row, primary: list[Row], i: Column) -> Column:
        """A part of a composite key: a digit of the permuted row number, in the base of its parent's rows; the last part has the rest."""
        table, n = c.table_name, self.rows[c.table_name]
        bases = [self.rows[p.fk_table] if self._references(p) and p.fk_table != table else None for p in primary]
        order = sorted(range(len(primary)), key=lambda k: bases[k] is None)
        total = 1
        for k in order:
            total *= bases[k] if bases[k] is not None else max(1, n)
        if total < n:
            raise ValueError(f"{table}: {n} rows but {total} keys")
        at = permuted(i, total, _salt(self.seed, table)) if total < 1 << 62 else i
        below = 1
        for k in order:
            base = bases[k] if bases[k] is not None else max(1, n)
            if primary[k].column_name == c.column_name:
                digit = F.pmod(F.call_function("div", at, F.lit(below)), F.lit(base))
                return digit if bases[k] is not None else self._typed(c, digit, True, 0)
            below *= base
        raise AssertionError

    def _typed(self, c: Row, x: Column, unique: bool, key: int) -> Column:
        """A value of the column's type for the number ``x``; different for different numbers if ``unique``."""
        kind = (c.col_type or "").lower()
        h = x if unique else F.xxhash64(x, F.lit(key))
        below = lambda m: F.pmod(h, F.lit(m))
        if "bool" in kind:
            return below(2) == 1
        if "int" in kind and "interval" not in kind or "serial" in kind:
            return (x + 1) if unique else below(1000)
        if any(w in kind for w in ("numeric", "decimal", "real", "double", "float", "money")):
            return (x if unique else below(100_000)) / F.lit(1.0 if unique else 100.0)
        if "time" in kind:
            return F.timestamp_seconds(F.lit(_EPOCH) + (x if unique else below(31_536_000)))
        if kind.startswith("date"):
            return F.date_add(F.lit("2024-01-01").cast("date"), (x if unique else below(365)).cast("int"))
        if "json" in kind:
            return F.concat(F.lit('{"n": '), h.cast("string"), F.lit("}"))
        if "uuid" in kind or (c.is_primary and c.varchar_len is None and not kind.startswith("char")):
            return uuid_from_index(x, _salt(c.table_name) if c.is_primary else key)
        name = c.column_name.lower()
        if "email" in name:
            text = F.concat(F.lit("user"), (x + 1).cast("string"), F.lit("@example.com"))
        else:
            text = F.concat(F.lit(f"{c.column_name} "), (x if unique else below(10_000)).cast("string"))
        if c.varchar_len is None:
            return text
        if not unique:
            return F.substring(text, 1, int(c.varchar_len))
        if 36 ** int(c.varchar_len) < self.rows[c.table_name]:
            raise ValueError(f"{c.table_name}.{c.column_name}: {c.varchar_len} characters don't tell {self.rows[c.table_name]} rows apart")
        return F.when(F.length(text) <= int(c.varchar_len), text).otherwise(F.lpad(F.conv(x.cast("string"), 10, 36), int(c.varchar_len), "0"))

    def table(self, spark: SparkSession, name: str, partitions: int | None = None) -> DataFrame:
        """One table; generated columns are null."""
        base = spark.range(0, self.rows[name], numPartitions=partitions)
        return base.select(*[(F.lit(None).cast("string") if c.is_generated else self.value(name, c.column_name, F.col("id"))).alias(c.column_name)
                             for c in self.tables[name]])


def generate_schema(spark: SparkSession, columns: DataFrame, rows: Mapping[str, int], enums: Mapping[str, list[str]] | None = None,
                    seed: int = 0) -> dict[str, DataFrame]:
    """G1 for every table of one schema (``schema_columns`` of one database), parents first. ``rows``: rows of each table. Raises where the
    rows can't keep the keys: more unique values than there are, or tables that need each other."""
    schema = columns.collect()  # one schema's columns
    missing = {c.table_name for c in schema} - set(rows)
    if missing:
        raise ValueError(f"no number of rows for {', '.join(sorted(missing))}")
    data = SchemaData(schema, rows, enums, seed)
    return {name: data.table(spark, name) for name in data.order()}
