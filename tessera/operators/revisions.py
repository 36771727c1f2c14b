"""Revision catalog views.

The catalog is a ``revisions`` DataFrame (scenario, revision, n, created_at,
schema_fingerprint, source, ...) as read by
:func:`tessera.sources.store.read_revision_catalog`, covering any number of
scenarios. Numbering and ordering use the hot-group-safe helpers of
:mod:`tessera.operators.sequence`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.catalog import column_note
from tessera.operators.sequence import ordered_index

REV_NUMBER = r"^r([0-9]+)\z"


def revision_number(rev):
    """``rNNN`` -> NNN; null for names of any other shape."""
    return F.when(rev.rlike(REV_NUMBER), F.regexp_extract(rev, REV_NUMBER, 1).cast("long"))


def format_revision(n):
    return F.format_string("r%03d", n)


def allocate_revisions(existing: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Number new revisions after the highest existing number of their scenario, in ``order``.

    ``existing(scenario, revision)``; names that are not ``rNNN`` are ignored.
    ``new(scenario, ...)`` gets ``n`` and ``revision``.
    """
    top = (existing.select("scenario", revision_number(F.col("revision")).alias("_n"))
           .groupBy("scenario").agg(F.max("_n").alias("_max")))
    idx = ordered_index(new, ["scenario"], order, name="_i")
    return (idx.join(top, "scenario", "left")
            .withColumn("n", F.coalesce(F.col("_max"), F.lit(0)) + F.col("_i") + 1)
            .withColumn("revision", format_revision(F.col("n")))
            .drop("_max", "_i"))


def latest_pointers(revisions: DataFrame) -> DataFrame:
    """Pointer per scenario: the highest-numbered revision."""
    return (revisions.withColumn("_n", revision_number(F.col("revision")))
            .groupBy("scenario").agg(F.max_by("revision", "_n").alias("latest")))


def resolve_revisions(requests: DataFrame, scenarios: DataFrame, revisions: DataFrame,
                      pointers: DataFrame | None = None) -> DataFrame:
    """``requests(request_id, scenario, revision?)`` -> resolved revision and status
    (``ok`` / ``missing_scenario`` / ``no_revisions`` / ``unknown_revision``)."""
    pointers = pointers if pointers is not None else latest_pointers(revisions)
    known = scenarios.select("scenario").distinct().withColumn("_known", F.lit(True))
    revs = (revisions.select(F.col("scenario").alias("_rs"), F.col("revision").alias("_rev")).distinct()
            .withColumn("_has", F.lit(True)))
    from tessera.functions.parse import strip_ws

    explicit = F.when(strip_ws(F.coalesce(F.col("revision"), F.lit(""))) != "", strip_ws(F.col("revision")))
    r = (requests.join(known, "scenario", "left").join(pointers, "scenario", "left")
         .withColumn("_want", F.coalesce(explicit, F.col("latest"))))
    r = r.join(revs, (F.col("scenario") == F.col("_rs")) & (F.col("_want") == F.col("_rev")), "left")
    # an explicit revision is looked up directly; only an implicit request needs the pointer
    status = (F.when(F.col("_known").isNull(), "missing_scenario")
              .when(F.col("_want").isNull(), "no_revisions")
              .when(F.col("_has").isNull(), "unknown_revision").otherwise("ok"))
    return r.select("request_id", "scenario", F.col("revision").alias("requested"),
                    F.when(status == "ok", F.col("_want")).alias("resolved"), status.alias("status"))


def revision_history(revisions: DataFrame, pointers: DataFrame | None = None, page: int | None = None,
                     page_size: int = 20) -> DataFrame:
    """Revisions newest first by number, with the latest label, 12-char schema id and whether a
    SQL script exists (``has_sql`` from the catalog scan; without it, any source other than a
    plain export).

    With ``page`` (0-based) only that page of each scenario's history is
    returned; positions come from the hot-group-safe ordered index.
    """
    pointers = pointers if pointers is not None else latest_pointers(revisions)
    out = (revisions.join(pointers, "scenario", "left")
           .select("scenario", "revision", revision_number(F.col("revision")).alias("n"),
                   (F.col("revision") == F.col("latest")).alias("is_latest"),
                   F.substring("schema_fingerprint", 1, 12).alias("schema_short"), "source",
                   (F.col("has_sql") if "has_sql" in revisions.columns
                    else (F.col("source") != "export")).alias("has_sql")))
    if page is not None:
        out = (ordered_index(out.withColumn("_neg", -F.col("n")), ["scenario"], ["_neg", "revision"], name="_pos")
               .where((F.col("_pos") >= page * page_size) & (F.col("_pos") < (page + 1) * page_size))
               .drop("_neg", "_pos"))
    return out.orderBy("scenario", F.col("n").desc())


def catalog_status(latest: DataFrame, live: DataFrame, behind: DataFrame | None = None,
                   summaries: DataFrame | None = None) -> DataFrame:
    """Per scenario its latest revision's schema against the live schema of its database,
    compared on the full fingerprints (the 12-character short ids are for display): ``current``, ``outdated``,
    ``noschema`` (the revision carries no fingerprint) or ``unknown`` (no live fingerprint for the
    database). ``behind`` (W5) and ``summaries(db_id, from_fp, to_fp, summary)`` (A5 between the
    stored and live schemas) are attached when given.

    ``latest(scenario, db_id, revision, schema_fingerprint)``, ``live(db_id, fingerprint)``.
    """
    j = latest.join(live.select("db_id", F.col("fingerprint").alias("live_fingerprint")), "db_id", "left")
    stored_short = F.substring("schema_fingerprint", 1, 12)
    live_short = F.substring("live_fingerprint", 1, 12)
    status = (F.when(F.coalesce(F.col("schema_fingerprint"), F.lit("")) == "", "noschema")
              .when(F.col("live_fingerprint").isNull(), "unknown")
              .when(F.col("schema_fingerprint") == F.col("live_fingerprint"), "current").otherwise("outdated"))
    out = j.select("scenario", "db_id", "revision", stored_short.alias("schema_short"), live_short.alias("live_short"),
                   status.alias("status"), "schema_fingerprint", "live_fingerprint")
    if summaries is not None:
        s = summaries.select("db_id", F.col("from_fp").alias("schema_fingerprint"),
                             F.col("to_fp").alias("live_fingerprint"), F.col("summary").alias("drift"))
        out = out.join(s, ["db_id", "schema_fingerprint", "live_fingerprint"], "left")
    out = out.drop("schema_fingerprint", "live_fingerprint")
    if behind is not None:
        out = out.join(behind.select("db_id", "revision", "behind"), ["db_id", "revision"], "left")
    return out


def sync_plan(local: DataFrame, remote: DataFrame, direction: str = "push") -> DataFrame:
    """Match local datasets to remote ones by stable id first, else by name.

    ``local(name, remote_id, remote_updated_at[, remote_scenario_id])``,
    ``remote(id, name, updated_at[, scenario_id])``: the stable match is on the
    scenario id when both sides carry it, else on the dataset id.
    A name matching no remote dataset is ``missing`` (push creates it), more
    than one is ``ambiguous``. Matched datasets are ``up_to_date`` only when the
    remote id and the remote update time are equal and non-empty, else ``push``.
    ``renamed`` marks an id match whose remote name differs. ``direction``
    (``push`` / ``pull``) names the transfer for datasets that are not up to date.
    """
    stable = "remote_scenario_id" in local.columns and "scenario_id" in remote.columns
    # several remote datasets with one stable id: the smallest (id, name, time) stands for them
    first = F.min(F.struct(F.col("id"), F.col("name"), F.col("updated_at")))
    by_id = (remote.groupBy((F.col("scenario_id") if stable else F.col("id")).alias("_sid")).agg(first.alias("r"))
             .select("_sid", F.col("r.id").alias("_id"), F.col("r.name").alias("_id_name"), F.col("r.updated_at").alias("_id_upd")))
    names = remote.groupBy(F.col("name").alias("_nm")).agg(
        F.count(F.lit(1)).alias("_n_named"), F.min("id").alias("_nm_id"), F.min("updated_at").alias("_nm_upd"))
    local_key = F.col("remote_scenario_id") if stable else F.col("remote_id")
    j = (local.join(by_id, (local_key == F.col("_sid")) & (F.coalesce(local_key, F.lit("")) != ""), "left")
         .join(names, local.name == names._nm, "left"))
    matched_id = F.col("_id").isNotNull()
    rid = F.when(matched_id, F.col("_id")).when(F.col("_n_named") == 1, F.col("_nm_id"))
    rupd = F.when(matched_id, F.col("_id_upd")).when(F.col("_n_named") == 1, F.col("_nm_upd"))
    up = (F.coalesce(F.col("remote_id"), F.lit("")) != "") & (F.col("remote_id") == rid) \
        & (F.coalesce(F.col("remote_updated_at"), F.lit("")) != "") & (F.col("remote_updated_at") == rupd)
    action = (F.when(~matched_id & (F.coalesce(F.col("_n_named"), F.lit(0)) > 1), "ambiguous")
              .when(~matched_id & F.col("_n_named").isNull(), "missing")
              .when(up, "up_to_date").otherwise(direction))
    return j.select("name", rid.alias("matched_remote_id"), action.alias("action"),
                    (matched_id & (F.col("_id_name") != F.col("name"))).alias("renamed"))


def revision_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per (pair, table) between two revisions: ``new`` / ``removed`` / ``changed`` (column set
    differs; a row-count change alone is ``unchanged``, as the source prints it) / ``unchanged``
    with row counts and the ``(cols: +a, -b)`` note. Inputs can come from A11's script stats.

    ``old`` / ``new``: (pair_id, table_name, row_count, columns array<string> in order).
    """
    o = old.select("pair_id", "table_name", F.col("row_count").alias("old_rows"), F.col("columns").alias("oc"))
    n = new.select("pair_id", "table_name", F.col("row_count").alias("new_rows"), F.col("columns").alias("nc"))
    j = o.join(n, ["pair_id", "table_name"], "full_outer")
    added = F.coalesce(F.array_except("nc", "oc"), F.array().cast("array<string>"))
    removed = F.coalesce(F.array_except("oc", "nc"), F.array().cast("array<string>"))
    note = column_note(added, removed)
    status = (F.when(F.col("oc").isNull(), "new").when(F.col("nc").isNull(), "removed")
              .when(note != "", "changed").otherwise("unchanged"))
    return j.select("pair_id", "table_name", status.alias("status"), "old_rows", "new_rows",
                    F.when(F.col("oc").isNotNull() & F.col("nc").isNotNull(), note).otherwise(F.lit("")).alias("note"))


def schema_inventory(schemas: DataFrame, datasets: DataFrame) -> DataFrame:
    """Per stored schema its short id, dataset count and recency (the later of the schema's
    own time and its newest dataset), newest first, ties by id.

    ``schemas(fingerprint, created_at)``, ``datasets(fingerprint, created_at)``.
    """
    ds = datasets.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("datasets"),
                                             F.max("created_at").alias("_newest"))
    s = schemas.groupBy("fingerprint").agg(F.min("created_at").alias("schema_time"))
    j = s.join(ds, "fingerprint", "left")
    return (j.select(F.substring("fingerprint", 1, 12).alias("short_id"), "fingerprint",
                     F.coalesce("datasets", F.lit(0)).alias("datasets"),
                     F.greatest("schema_time", "_newest").alias("recency"))
            .orderBy(F.col("recency").desc(), "short_id"))


def lookup_schema(inventory: DataFrame, ref: str) -> tuple[str, DataFrame]:
    """Resolve a schema reference: ('none' | 'one' | 'many', all matching rows).

    The reference is trimmed and lower-cased and matches a prefix of the short
    or full fingerprint, or a non-empty ``display_name`` (case-insensitive,
    when the inventory has one). An empty reference resolves only when the
    inventory holds exactly one schema. Only the number of matches reaches the driver.
    """
    ref = (ref or "").strip().lower()
    if not ref:
        cond = F.lit(True)
    else:
        cond = F.lower("short_id").startswith(ref) | F.lower("fingerprint").startswith(ref)
        if "display_name" in inventory.columns:
            name = F.lower(F.trim(F.col("display_name")))
            cond = cond | ((F.coalesce(name, F.lit("")) != "") & (name == F.lit(ref)))
    found = inventory.where(cond)
    n = found.count()
    return ("none" if not n else "one" if n == 1 else "many"), found
