"""Schema diff and drift classification over catalog pairs.

Inputs are two catalogs (``old`` and ``new``, the ``schema_columns`` shape of
:mod:`tessera.operators.catalog`) holding any number of databases; a database
is compared with the database of the same ``db_id`` in the other version.
All work is joins on (db, table[, column]) plus column expressions; no pair of
rows is ever generated beyond what the keys match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANGE_KINDS = ("table_added", "table_removed", "column_added", "column_removed", "column_changed",
                "fk_added", "fk_removed", "fk_changed")

# Reason texts of the drift classification (``%s`` = formatted argument).
DRIFT_REASONS = {
    "table_added": "new table — no existing data affected",
    "table_removed": "table removed — possible FK references from other tables",
    "column_removed": "column removed — drop from CSV",
    "added_no_metadata": "new column — schema metadata unavailable",
    "added_generated": "generated column — no CSV value needed",
    "added_rename": "possible rename from %s (same type)",
    "added_nullable": "nullable column — fill with empty",
    "added_default": "column has a default — fill with %s",
    "added_required_fk": "required FK column references %s.%s — need a valid parent row",
    "added_required": "NOT NULL column without default — need a fill strategy",
    "fk_added": "FK added to existing column referencing %s — existing rows may violate constraint",
    "fk_removed": "FK removed — no CSV transformation needed",
    "fk_changed": "FK target changed to %s — existing references may need update",
}

_CMP = ["col_type", "nullable", "col_default", "is_primary", "is_unique", "is_generated", "fk_table", "fk_column"]


def _b(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), F.lit("true")).otherwise(F.lit("false"))


def _raw_display(c: Column) -> Column:
    """A string default shown as its JSON text (quoted, escaped); absent shows ``null``."""
    return F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1))


def _fk_ref(t: Column, c: Column) -> Column:
    return F.when(t.isNotNull(), F.concat(t, F.lit("."), F.coalesce(c, F.lit(""))))


def _change(kind: str, detail: Column | None, seq: int, cond: Column) -> Column:
    return F.when(cond, F.struct(F.lit(kind).alias("kind"),
                                 (detail if detail is not None else F.lit("")).alias("detail"),
                                 F.lit(seq).alias("seq")))


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """changes(db_id, kind, table_name, column_name, detail, seq); see :func:`diff_with_meta`."""
    return diff_with_meta(old, new).drop("o", "n")


def drift_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """:func:`diff_with_meta` materialized once in the shared checkpoint folder, for the several
    consumers of a refresh (renames, classification, reports) that would otherwise each recompute
    the full catalog joins."""
    from tessera.session import cut_lineage
    return cut_lineage(diff_with_meta(old, new))


def diff_with_meta(old: DataFrame, new: DataFrame) -> DataFrame:
    """J2 with the old (``o``) and new (``n``) column attributes kept on every change row.

    Rows: (db_id, kind, table_name, column_name, detail, seq, o, n), ordered by table then column.

    An added or removed table gives one table-level row and no column rows; an
    added column with a foreign key gives a column row and an FK row; a column
    present on both sides gives a ``column_changed`` row listing the changed
    attributes (type, nullable, default, isPrimary, isUnique, isGenerated) and
    an FK row when the reference target changed. Enum and varchar length are
    not compared (trap Q10).
    """
    # both sides tagged in one frame: a row per column with what each side has, then the table's presence
    attributes = F.struct(*[F.col(c) for c in _CMP])
    sides = old.select("db_id", "table_name", "column_name", attributes.alias("o")).unionByName(
        new.select("db_id", "table_name", "column_name", attributes.alias("n")), allowMissingColumns=True)
    table = Window.partitionBy("db_id", "table_name")
    cols = (sides.groupBy("db_id", "table_name", "column_name").agg(F.max("o").alias("o"), F.max("n").alias("n"))
            .withColumn("_old", F.max(F.col("o").isNotNull()).over(table)).withColumn("_new", F.max(F.col("n").isNotNull()).over(table))
            .withColumn("_i", F.row_number().over(table.orderBy("column_name"))))
    o, n = F.col("o"), F.col("n")
    added, removed, present = o.isNull(), n.isNull(), o.isNotNull() & n.isNotNull()

    describe = F.concat_ws(" ", n.col_type, F.concat(F.lit("nullable="), _b(n.nullable)),
                           F.when(n.col_default.isNotNull(), F.concat(F.lit("default="), _raw_display(n.col_default))),
                           F.when(F.coalesce(n.is_generated, F.lit(False)), F.lit("generated")))

    def bit(label, a, b, show):
        return F.when(~(a.eqNullSafe(b)), F.format_string("%s %s -> %s", F.lit(label), show(a), show(b)))

    bits = F.concat_ws(", ",
                       bit("type changed", o.col_type, n.col_type, lambda c: c),
                       bit("nullable", F.coalesce(o.nullable, F.lit(False)), F.coalesce(n.nullable, F.lit(False)), _b),
                       bit("default", o.col_default, n.col_default, _raw_display),
                       bit("isPrimary", F.coalesce(o.is_primary, F.lit(False)), F.coalesce(n.is_primary, F.lit(False)), _b),
                       bit("isUnique", F.coalesce(o.is_unique, F.lit(False)), F.coalesce(n.is_unique, F.lit(False)), _b),
                       bit("isGenerated", F.coalesce(o.is_generated, F.lit(False)),
                           F.coalesce(n.is_generated, F.lit(False)), _b))
    old_ref, new_ref = _fk_ref(o.fk_table, o.fk_column), _fk_ref(n.fk_table, n.fk_column)
    fk_differs = ~F.coalesce(old_ref, F.lit("")).eqNullSafe(F.coalesce(new_ref, F.lit("")))
    fk_detail = (F.when(o.fk_table.isNull(), F.concat(F.lit("-> "), new_ref))
                 .when(n.fk_table.isNull(), F.lit("(removed)"))
                 .otherwise(F.concat(old_ref, F.lit(" -> "), new_ref)))
    fk_kind = (F.when(o.fk_table.isNull(), F.lit("fk_added")).when(n.fk_table.isNull(), F.lit("fk_removed"))
               .otherwise(F.lit("fk_changed")))
    both = F.col("_old") & F.col("_new")
    table_kind = F.when(F.col("_old"), F.lit("table_removed")).otherwise(F.lit("table_added"))
    candidates = F.array(
        F.when(~both & (F.col("_i") == 1), F.struct(table_kind.alias("kind"), F.lit("").alias("detail"), F.lit(0).alias("seq"))),
        _change("column_added", describe, 1, both & added),
        _change("fk_added", new_ref, 2, both & added & n.fk_table.isNotNull()),
        _change("column_removed", None, 1, both & removed),
        _change("column_changed", bits, 1, present & (bits != "")),
        F.when(present & fk_differs, F.struct(fk_kind.alias("kind"), fk_detail.alias("detail"), F.lit(2).alias("seq"))),
    )
    whole = F.col("c.seq") == 0  # a change of the whole table
    return (cols.select("db_id", "table_name", "column_name", "o", "n", F.explode(F.filter(candidates, lambda x: x.isNotNull())).alias("c"))
            .select("db_id", F.col("c.kind").alias("kind"), "table_name", F.when(whole, "").otherwise(F.col("column_name")).alias("column_name"),
                    F.col("c.detail").alias("detail"), F.col("c.seq").alias("seq"),
                    *[F.when(~whole, F.col(side)).alias(side) for side in ("o", "n")]))


def change_text(kind: Column, table: Column, column: Column, detail: Column) -> Column:
    """One change rendered the way the check command prints it."""
    tc = F.concat(table, F.lit("."), column)
    return (F.when(kind == "table_added", F.concat(F.lit("+ table "), table, F.lit(" added")))
            .when(kind == "table_removed", F.concat(F.lit("- table "), table, F.lit(" removed")))
            .when(kind == "column_added", F.concat(F.lit("+ "), tc, F.lit(" added"),
                                                   F.when(detail != "", F.concat(F.lit(" "), detail)).otherwise(F.lit(""))))
            .when(kind == "column_removed", F.concat(F.lit("- "), tc, F.lit(" removed")))
            .when(kind == "column_changed", F.concat(F.lit("~ "), tc, F.lit(" "), detail))
            .when(kind == "fk_added", F.concat(F.lit("+ "), tc, F.lit(" FK -> "), detail))
            .when(kind == "fk_removed", F.concat(F.lit("- "), tc, F.lit(" FK removed")))
            .when(kind == "fk_changed", F.concat(F.lit("~ "), tc, F.lit(" FK "), detail))
            .otherwise(F.concat(F.lit("? "), tc, F.lit(" "), detail)))


# ----------------------------------------------------------------------- A5

def diff_summary(changes: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """A5: per database counts of +tbl -tbl +col -col ~col and the compact text (``-`` when none).

    FK kinds are not counted. ``pairs`` (``db_id``) adds databases with no change.
    """
    def n(kind):
        return F.count_if(F.col("kind") == kind)

    agg = changes.groupBy("db_id").agg(n("table_added").alias("added_tables"), n("table_removed").alias("removed_tables"),
                                       n("column_added").alias("added_columns"),
                                       n("column_removed").alias("removed_columns"),
                                       n("column_changed").alias("changed_columns"))
    if pairs is not None:
        agg = pairs.select("db_id").distinct().join(agg, "db_id", "left").na.fill(0)
    return agg.withColumn("summary", summary_text(*[F.col(c) for c in (
        "added_tables", "removed_tables", "added_columns", "removed_columns", "changed_columns")]))


def summary_text(at: Column, rt: Column, ac: Column, rc: Column, cc: Column) -> Column:
    def part(c, fmt):
        return F.when(c > 0, F.format_string(fmt, c))
    txt = F.concat_ws(" ", part(at, "+%d tbl"), part(rt, "-%d tbl"), part(ac, "+%d col"), part(rc, "-%d col"),
                      part(cc, "~%d col"))
    return F.when(txt == "", F.lit("-")).otherwise(txt)


# ----------------------------------------------------------------------- J3

def detect_renames(changes: DataFrame, old: DataFrame | None = None, new: DataFrame | None = None) -> DataFrame:
    """For each added column, the first (by name) dropped column of the same table and type
    whose name is similar: one is a prefix or suffix of the other (case-insensitive), or
    shorter/longer length >= 0.6.

    Candidates are found without pairing every added with every dropped column:
    the length rule becomes a join on (db, table, type, length) against the
    smallest dropped name of each length (a bounded number of lengths per
    added column), and the prefix/suffix rule becomes equi-joins of each name
    against the prefixes and suffixes of the other side. Fan-out per column is
    bounded by identifier length, not by table width.
    """
    key = ["db_id", "table_name", "col_type"]
    if "n" in changes.columns:  # change rows carry the column attributes (diff_with_meta)
        added = (changes.where(F.col("kind") == "column_added")
                 .select("db_id", "table_name", F.col("n.col_type").alias("col_type"),
                         F.col("column_name").alias("added"), F.lower("column_name").alias("al")))
        dropped = (changes.where(F.col("kind") == "column_removed")
                   .select("db_id", "table_name", F.col("o.col_type").alias("col_type"),
                           F.col("column_name").alias("dropped"), F.lower("column_name").alias("dl")))
    else:
        added = (changes.where(F.col("kind") == "column_added").select("db_id", "table_name", "column_name")
                 .join(new.select("db_id", "table_name", "column_name", "col_type"),
                       ["db_id", "table_name", "column_name"])
                 .select(*key, F.col("column_name").alias("added"), F.lower("column_name").alias("al")))
        dropped = (changes.where(F.col("kind") == "column_removed").select("db_id", "table_name", "column_name")
                   .join(old.select("db_id", "table_name", "column_name", "col_type"),
                         ["db_id", "table_name", "column_name"])
                   .select(*key, F.col("column_name").alias("dropped"), F.lower("column_name").alias("dl")))

    # length-ratio rule: smallest dropped name of each length
    by_len = dropped.groupBy(*key, F.length("dl").alias("dlen")).agg(F.min("dropped").alias("dropped"))
    a_len = added.withColumn("alen", F.length("al")).withColumn(
        "dlen", F.explode(F.sequence(F.expr("CAST((3 * alen + 4) DIV 5 AS INT)"),
                                     F.expr("CAST(greatest((5 * alen) DIV 3, 0) AS INT)"))))
    ratio_hits = (a_len.where(F.col("dlen") > 0).join(by_len, key + ["dlen"])
                  .select(*key, "added", "dropped"))

    def affixes(df, col):
        # every prefix and every suffix of a lower-cased name (length 1..len)
        ln = F.length(col)
        return df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest(ln, F.lit(1))))) \
                 .withColumn("_aff", F.explode(F.array(F.expr(f"substring({col}, 1, _i)"),
                                                        F.expr(f"substring({col}, -_i)")))) \
                 .drop("_i")

    # dropped name is a prefix/suffix of the added name
    d_in_a = (affixes(added, "al").join(dropped.select(*key, "dropped", F.col("dl").alias("_aff")), key + ["_aff"])
              .select(*key, "added", "dropped"))
    # added name is a prefix/suffix of the dropped name
    a_in_d = (affixes(dropped, "dl").join(added.select(*key, "added", F.col("al").alias("_aff")), key + ["_aff"])
              .select(*key, "added", "dropped"))
    hits = ratio_hits.unionByName(d_in_a).unionByName(a_in_d)
    return (hits.groupBy("db_id", "table_name", "added").agg(F.min("dropped").alias("from_column"))
            .withColumnRenamed("added", "column_name"))


# ----------------------------------------------------------------------- J4

_WIDENINGS = [  # fixed values: safe widenings recognised in a "type changed" detail
    ("varchar", "text"),
    ("character varying", "text"),
    ("integer", "bigint"),
    ("int", "bigint"),
    ("float", "double"),
    ("real", "double precision"),
    ("timestamp without time zone", "timestamp with time zone"),
]


def _column_changed_category(detail: Column) -> Column:
    d = F.lower(detail)
    widening = F.lit(False)
    for a, b in _WIDENINGS:
        widening = widening | (d.contains(a) & d.contains(b))
    return (F.when(d.contains("isprimary"), F.lit("breaking"))
            .when(d.contains("type changed"), F.when(widening, F.lit("likely")).otherwise(F.lit("breaking")))
            .when(d.contains("nullable"), F.when(d.contains("true -> false"), F.lit("decision")).otherwise(F.lit("auto")))
            .when(d.contains("default"), F.lit("auto"))
            .when(d.contains("isgenerated"), F.lit("likely"))
            .when(d.contains("isunique true"), F.lit("decision"))
            .when(d.contains("isunique false"), F.lit("auto"))
            .otherwise(F.lit("likely")))


def _structured_changed_category(o: Column, n: Column) -> Column:
    """Trap Q11, fixed: classify a changed column from its old/new attributes instead of the
    detail text. Adding a unique constraint needs a decision (existing duplicates), dropping it is
    safe; a type change is a widening only from the narrower to the wider type."""
    ot, nt = F.lower(o.col_type), F.lower(n.col_type)
    widening = F.lit(False)
    for a, b in _WIDENINGS:
        widening = widening | (ot.contains(a) & nt.contains(b) & ~ot.contains(b))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return (F.when(flag(o.is_primary) != flag(n.is_primary), F.lit("breaking"))
            .when(~o.col_type.eqNullSafe(n.col_type), F.when(widening, F.lit("likely")).otherwise(F.lit("breaking")))
            .when(flag(o.nullable) & ~flag(n.nullable), F.lit("decision"))
            .when(flag(o.nullable) != flag(n.nullable), F.lit("auto"))
            .when(~o.col_default.eqNullSafe(n.col_default), F.lit("auto"))
            .when(flag(o.is_generated) != flag(n.is_generated), F.lit("likely"))
            .when(~flag(o.is_unique) & flag(n.is_unique), F.lit("decision"))
            .when(flag(o.is_unique) & ~flag(n.is_unique), F.lit("auto"))
            .otherwise(F.lit("likely")))


def classify_drift(changes: DataFrame, old: DataFrame | None = None, new: DataFrame | None = None,
                   renames: DataFrame | None = None, compat: bool = True) -> DataFrame:
    """Category (auto / likely / decision / breaking), reason and suggested operation per change.

    Rules follow the source's order. With ``compat=True`` (default) changed
    columns are classified from the detail text as the source does (trap Q11:
    dropping a unique flag is a decision, widening pairs match in either
    direction); ``compat=False`` classifies from the structured attributes
    (needs change rows from :func:`diff_with_meta`).
    """
    from tessera.operators.catalog import default_strategy

    if renames is None:
        renames = detect_renames(changes, old, new)
    if "n" in changes.columns:  # attributes of the new column travel with the change row
        ch = (changes.withColumn("m", F.when(F.col("kind") == "column_added", F.col("n")))
              .join(renames, ["db_id", "table_name", "column_name"], "left"))
    else:
        meta = new.select("db_id", "table_name", "column_name",
                          F.struct("col_type", "nullable", "col_default", "is_generated", "fk_table",
                                   "fk_column").alias("m"))
        ch = (changes.join(meta, ["db_id", "table_name", "column_name"], "left")
              .join(renames, ["db_id", "table_name", "column_name"], "left"))
    kind, m = F.col("kind"), F.col("m")
    is_add = kind == "column_added"
    has_default = m.col_default.isNotNull()
    strategy = default_strategy(m.col_default, m.col_type)
    cat = (F.when(kind == "table_added", "auto").when(kind == "table_removed", "breaking")
           .when(kind == "column_removed", "auto")
           .when(is_add & m.isNull(), "decision")
           .when(is_add & F.coalesce(m.is_generated, F.lit(False)), "auto")
           .when(is_add & F.col("from_column").isNotNull(), "likely")
           .when(is_add & F.coalesce(m.nullable, F.lit(False)), "auto")
           .when(is_add & has_default, "auto")
           .when(is_add, "decision")
           .when(kind == "column_changed",
                 _column_changed_category(F.col("detail")) if compat or "o" not in changes.columns
                 else _structured_changed_category(F.col("o"), F.col("n")))
           .when(kind == "fk_added", "decision").when(kind == "fk_removed", "auto")
           .when(kind == "fk_changed", "likely").otherwise("decision"))
    reason = (F.when(kind == "table_added", DRIFT_REASONS["table_added"])
              .when(kind == "table_removed", DRIFT_REASONS["table_removed"])
              .when(kind == "column_removed", DRIFT_REASONS["column_removed"])
              .when(is_add & m.isNull(), DRIFT_REASONS["added_no_metadata"])
              .when(is_add & F.coalesce(m.is_generated, F.lit(False)), DRIFT_REASONS["added_generated"])
              .when(is_add & F.col("from_column").isNotNull(),
                    F.format_string(DRIFT_REASONS["added_rename"], F.col("from_column")))
              .when(is_add & F.coalesce(m.nullable, F.lit(False)), DRIFT_REASONS["added_nullable"])
              .when(is_add & has_default, F.format_string(DRIFT_REASONS["added_default"], strategy))
              .when(is_add & m.fk_table.isNotNull(),
                    F.format_string(DRIFT_REASONS["added_required_fk"], m.fk_table, F.coalesce(m.fk_column, F.lit(""))))
              .when(is_add, DRIFT_REASONS["added_required"])
              .when(kind == "fk_added", F.format_string(DRIFT_REASONS["fk_added"], F.col("detail")))
              .when(kind == "fk_removed", DRIFT_REASONS["fk_removed"])
              .when(kind == "fk_changed", F.format_string(DRIFT_REASONS["fk_changed"], F.col("detail")))
              .otherwise(F.lit("")))
    op = (F.when(kind == "column_removed", "drop_column")
          .when(is_add & m.isNotNull() & ~F.coalesce(m.is_generated, F.lit(False)),
                F.when(F.col("from_column").isNotNull(), "rename_column")
                .when(F.coalesce(m.nullable, F.lit(False)) | has_default, "add_column")))
    op_strategy = F.when(op == "add_column",
                         F.when(F.coalesce(m.nullable, F.lit(False)), F.lit("constant")).otherwise(strategy))
    op_value = (F.when(op == "rename_column", F.col("from_column"))
                .when((op == "add_column") & F.coalesce(m.nullable, F.lit(False)), F.lit("")))
    return ch.select("db_id", "kind", "table_name", "column_name", "detail", "seq",
                     cat.alias("category"), reason.alias("reason"), op.alias("op"),
                     op_strategy.alias("op_strategy"), op_value.alias("op_value"))


# ----------------------------------------------------------------------- A6

def drift_report(classified: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Per database the counts per category and the four flags.

    A database listed in ``pairs`` without any change reports no drift and is
    auto-resolvable (trap Q26).
    """
    def n(c):
        return F.count_if(F.col("category") == c)

    agg = classified.groupBy("db_id").agg(n("auto").alias("n_auto"), n("likely").alias("n_likely"),
                                          n("decision").alias("n_decision"), n("breaking").alias("n_breaking"),
                                          F.count(F.lit(1)).alias("n_changes"))
    if pairs is not None:
        agg = pairs.select("db_id").distinct().join(agg, "db_id", "left").na.fill(0)
    return agg.select("db_id", "n_auto", "n_likely", "n_decision", "n_breaking",
                      (F.col("n_changes") > 0).alias("has_drift"),
                      ((F.col("n_decision") == 0) & (F.col("n_breaking") == 0) & (F.col("n_likely") == 0))
                      .alias("auto_resolvable"),
                      (F.col("n_decision") > 0).alias("needs_decision"),
                      (F.col("n_breaking") > 0).alias("has_breaking"))


# ----------------------------------------------------------------------- G4

def sync_fingerprint(revisions: DataFrame, live_fp: DataFrame, changes: DataFrame) -> DataFrame:
    """Revisions whose stored fingerprint differs from the live one while the structural
    diff is empty get the live fingerprint; the data is untouched.

    ``revisions(db_id, ..., schema_fingerprint)``, ``live_fp(db_id, fingerprint)``,
    ``changes`` from :func:`schema_diff` between the stored and live catalogs.
    """
    changed = changes.select("db_id").distinct().withColumn("_has_diff", F.lit(True))
    j = revisions.join(live_fp.select("db_id", F.col("fingerprint").alias("_live")), "db_id", "left") \
                 .join(changed, "db_id", "left")
    resync = (F.col("_live").isNotNull() & (F.col("_live") != F.col("schema_fingerprint"))
              & F.col("_has_diff").isNull())
    return j.select(*[c for c in revisions.columns if c != "schema_fingerprint"],
                    F.when(resync, F.col("_live")).otherwise(F.col("schema_fingerprint")).alias("schema_fingerprint"),
                    resync.alias("fingerprint_synced"))
