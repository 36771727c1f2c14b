"""Structured Streaming versions of the usage fold, schema history and restore.

* X1 ``stream_usage``: newest sighting per test key as a streaming aggregation
  (``max(struct(last_seen_at, ...))`` is order-independent, so any file split
  and any arrival order give the batch answer). State lives in the query's
  checkpoint. ``update`` mode emits only the keys a micro-batch changed; each
  batch writes them to its own ``deltas/batch_id=N`` folder (overwrite, so a
  retried batch is idempotent). Readers fold the deltas with the same
  ``max(struct)`` (:func:`read_usage_latest`); :func:`compact_usage` folds them
  into a new base. Work per micro-batch grows with the changed keys, not with
  the total state.
* X2 ``stream_schema_history``: the state is the history itself, one row per (database, fingerprint). A micro-batch whose sightings of
  a database are newer than all before is merged into that database's rows from its last sighting on; only the rows that change are
  written, to ``state/batch_id=N``. A database with a late sighting is computed again from the log of sightings, which nothing else
  reads. Rows and log are cut into buckets by database, and every few batches the rows are folded into a new base, so a
  batch reads the buckets it touches of the base and of few deltas.
* X3 ``stream_restore``: marker resolution and coercion are stateless column
  expressions applied to the stream and appended to a Parquet sink.

Sources are file streams (the reference's only feed is a folder of event
files); any other streaming source with the same columns works unchanged.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.coerce import coerce_table
from tessera.functions.markers import _values_map, is_marker, marker_key
from tessera.operators.history import schema_history
from tessera.operators.sequence import ordered_index
from tessera.operators.usage import USAGE_KEY
from tessera.session import cut_lineage
from tessera.sources import store


def _limited(reader, max_files: int | None):
    """Files per micro-batch only as the caller asks; by default a batch takes all that is new."""
    return reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)


def _file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str, max_files: int | None) -> DataFrame:
    r = _limited(spark.readStream.schema(schema).format(fmt), max_files)
    if fmt == "csv":  # snapshot CSV: header, RFC 4180 quotes, cells kept verbatim, empty cells as ""
        r = (r.option("header", True).option("escape", '"').option("multiLine", True)
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
             .option("nullValue", "\u0001<null>\u0001").option("emptyValue", ""))
        df = r.load(path)
        return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
    return r.load(path)


def _event_json_stream(spark: SparkSession, source: str, max_files: int | None) -> DataFrame:
    """Usage-event JSON files as written by the test integration (camelCase fields); malformed
    events and events without a state are skipped, as the batch reader (S5) does."""
    from tessera.sources.usage_events import EVENT_SCHEMA

    raw = _limited(spark.readStream.schema(EVENT_SCHEMA).option("mode", "PERMISSIVE")
                   .option("columnNameOfCorruptRecord", "_corrupt_record"), max_files).json(source)
    return (raw.where(F.col("_corrupt_record").isNull() & F.col("state").isNotNull() & (F.col("state") != ""))
            .select("state", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("title", F.lit("")).alias("title"),
                    F.coalesce("project", F.lit("")).alias("project"), F.col("resetMode").alias("reset_mode"),
                    F.try_to_timestamp("lastSeenAt").alias("last_seen_at"), F.col("testHash").alias("test_hash")))


def stream_usage(spark: SparkSession, source: str, schema: T.StructType | None, out: str, checkpoint: str,
                 fmt: str = "parquet", max_files_per_trigger: int | None = None, available_now: bool = True):
    """Continuous latest-per-key usage; read with :func:`read_usage_latest`. Returns the query.

    ``fmt='event-json'`` reads the test integration's event files directly (``schema`` unused).
    """
    ev = (_event_json_stream(spark, source, max_files_per_trigger) if fmt == "event-json"
          else _file_stream(spark, source, schema, fmt, max_files_per_trigger))
    latest = (ev.groupBy(*USAGE_KEY).agg(F.max(F.struct("last_seen_at", "test_hash", "reset_mode")).alias("_n"))
              .select(*USAGE_KEY, F.col("_n.reset_mode").alias("reset_mode"),
                      F.col("_n.last_seen_at").alias("last_seen_at"), F.col("_n.test_hash").alias("test_hash")))
    deltas = f"{out.rstrip('/')}/deltas"

    def write_delta(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{deltas}/batch_id={batch_id}")

    w = latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write_delta)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_usage_latest(spark: SparkSession, out: str) -> DataFrame:
    """Fold of the base (if compacted) and every delta: newest sighting per test key."""
    from tessera.operators.usage import latest_usage

    root = out.rstrip("/")
    parts = []
    fs = store.FS(spark)
    folded = None
    if fs.exists(f"{root}/base/_current"):
        parts.append(store.read_published(spark, f"{root}/base", "usage_latest"))
        folded = store.read_published(spark, f"{root}/base", "folded").first()["batch_id"]
    if fs.exists(f"{root}/deltas"):
        deltas = spark.read.parquet(f"{root}/deltas")
        if folded is not None:  # batches that the base holds: their folders are pruned
            deltas = deltas.where(F.col("batch_id") > folded)
        parts.append(deltas.drop("batch_id"))
    if not parts:
        raise LookupError(f"no usage state under {out!r}")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return latest_usage(union)


def compact_usage(spark: SparkSession, out: str) -> None:
    """Publish the current fold as the new base, with the last batch that it holds; readers then take
    newer deltas only. Batches are written in order, so a delta that is there has all before it; one that
    lands while this runs is newer than the recorded batch and is read again, which changes nothing."""
    root = out.rstrip("/")
    batches = [int(d.split("=")[1]) for d in store.FS(spark).list_dirs(f"{root}/deltas") if d.startswith("batch_id=")]
    last = spark.createDataFrame([(max(batches, default=None),)], "batch_id long")
    store.publish_tables(spark, f"{root}/base", {"usage_latest": read_usage_latest(spark, out), "folded": last})


#: Bytes of source files for one bucket of the history's state and log, and the fewest buckets.
BUCKET_BYTES, FEWEST_BUCKETS = 256 << 20, 64
#: Micro-batches between two folds of the history's state.
FOLD_EVERY = 32
_HISTORY = ["db_id", "fingerprint", "version", "first_seen", "last_seen", "previous"]


def _buckets(spark: SparkSession, source: str, root: str) -> int:
    """Number of buckets of a stream's state: from the volume of the source when the stream first starts, then fixed."""
    fs = store.FS(spark)
    if (text := fs.read_text(f"{root}/buckets")) is None:
        size = sum(fs._fs(f).getFileStatus(fs._p(f)).getLen() for f in fs.list_files(source)) if fs.exists(source) else 0
        text = str(max(FEWEST_BUCKETS, size // BUCKET_BYTES))
        fs.mkdirs(root)
        fs.write_text(f"{root}/buckets", text)
    return int(text)


def stream_schema_history(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str,
                          fmt: str = "parquet", max_files_per_trigger: int | None = None, available_now: bool = True):
    """Continuous W4; read with :func:`read_schema_history`. Returns the query."""
    obs = _file_stream(spark, source, schema, fmt, max_files_per_trigger).select("db_id", "fingerprint", "seen_at")
    root = out.rstrip("/")
    buckets = _buckets(spark, source, root)
    bucket = F.pmod(F.xxhash64("db_id"), F.lit(buckets)).cast("int").alias("bucket")

    def fold(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        log_path = f"{root}/log"
        # one folder per batch, overwritten on a retry; one file per bucket
        batch.select("*", bucket).distinct().repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{log_path}/batch_id={batch_id}")
        seen = s.read.schema(batch.select("*", bucket).schema).parquet(f"{log_path}/batch_id={batch_id}")
        touched = sorted(r.bucket for r in seen.select("bucket").distinct().collect())  # a number per bucket
        state = _history_state(s, root, batch_id, touched)
        rows = _merged_history(seen.drop("bucket"), state, lambda: s.read.parquet(log_path).where(
            F.col("bucket").isin(touched) & (F.col("batch_id") <= batch_id)).drop("bucket", "batch_id"))
        rows.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/state/batch_id={batch_id}")
        if batch_id % FOLD_EVERY == FOLD_EVERY - 1:
            compact_schema_history(s, root, batch_id)

    w = obs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _merged_history(seen: DataFrame, state: DataFrame | None, log) -> DataFrame:
    """History rows that the sightings ``seen`` change. ``state``: the history rows before; ``log()``: all sightings."""
    if state is None:
        return schema_history(seen)
    state = state.join(seen.select("db_id").distinct(), "db_id", "left_semi")
    last = state.groupBy("db_id").agg(F.max(F.struct(F.col("last_seen").alias("seen_at"), "fingerprint")).alias("last"), F.max("version").alias("known"))
    seen = seen.join(last, "db_id", "left").withColumn("here", F.struct("seen_at", "fingerprint"))
    late = cut_lineage(seen.where("here < last").select("db_id").distinct())
    new = seen.join(late, "db_id", "left_anti").where("last IS NULL OR here > last").select("db_id", "fingerprint", "seen_at")
    # in order: the history of the new sightings behind the last one before them
    begin = last.join(new.select("db_id").distinct(), "db_id", "left_semi").select("db_id", "last.fingerprint", "last.seen_at")
    part = schema_history(new.unionByName(begin))
    known = state.select("db_id", "fingerprint", *[F.col(c).alias(f"old_{c}") for c in ("version", "first_seen", "previous")])
    part = cut_lineage(part.join(known, ["db_id", "fingerprint"], "left"))
    old = part.where("old_version IS NOT NULL").select("db_id", "fingerprint", F.col("old_version").alias("version"), F.col("old_first_seen").alias("first_seen"),
                                                       "last_seen", F.col("old_previous").alias("previous"))
    fresh = ordered_index(part.where("old_version IS NULL"), ["db_id"], ["version"], "place").join(last.select("db_id", "known"), "db_id", "left")
    fresh = fresh.select("db_id", "fingerprint", (F.coalesce("known", F.lit(0)) + F.col("place") + 1).alias("version"), "first_seen", "last_seen", "previous")
    rows = old.unionByName(fresh)
    if late.isEmpty():
        return rows
    return rows.unionByName(schema_history(log().join(late, "db_id", "left_semi")))


def _history_state(spark: SparkSession, root: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """History rows after the batches before ``before`` (all), of some buckets (all): of each database and fingerprint the newest."""
    fs, parts, folded = store.FS(spark), [], -1
    if fs.exists(f"{root}/base/_current"):
        folded = store.read_published(spark, f"{root}/base", "folded").first()["batch_id"]
        if before is None or folded < before:
            parts.append(store.read_published(spark, f"{root}/base", "history").withColumn("batch_id", F.lit(folded)))
        else:
            folded = -1  # a retried batch that the base holds already
    batches = [int(d.split("=")[1]) for d in fs.list_dirs(f"{root}/state") if d.startswith("batch_id=")]
    if any(b > folded and (before is None or b < before) for b in batches):
        deltas = spark.read.parquet(f"{root}/state").where(F.col("batch_id") > folded)
        parts.append(deltas if before is None else deltas.where(F.col("batch_id") < before))
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    newest = rows.groupBy("db_id", "fingerprint").agg(F.max(F.struct("batch_id", *_HISTORY[2:], "bucket")).alias("r"))
    return newest.select("db_id", "fingerprint", *[f"r.{c}" for c in (*_HISTORY[2:], "bucket")])


def compact_schema_history(spark: SparkSession, out: str, batch_id: int | None = None) -> None:
    """Publish the history so far as the new base, cut by bucket, with the last batch that it holds."""
    root = out.rstrip("/")
    if batch_id is None:
        batch_id = max((int(d.split("=")[1]) for d in store.FS(spark).list_dirs(f"{root}/state") if d.startswith("batch_id=")), default=None)
    if batch_id is None:
        return
    rows = _history_state(spark, root, batch_id + 1)
    store.publish_tables(spark, f"{root}/base", {"history": rows.repartitionByRange("bucket"), "folded": spark.createDataFrame([(batch_id,)], "batch_id long")})


def read_schema_history(spark: SparkSession, out: str) -> DataFrame:
    """The history after all batches: one row per database and fingerprint."""
    rows = _history_state(spark, out.rstrip("/"))
    if rows is None:
        raise LookupError(f"no history under {out!r}")
    return rows.select(*_HISTORY)


def stream_restore(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str,
                   values: Mapping[str, str], types: Mapping[str, str] | None = None, dialect: str = "postgres",
                   fmt: str = "parquet", max_files_per_trigger: int | None = None, available_now: bool = True):
    """Marker resolution (+ optional coercion) on a stream; read with :func:`read_restored`.

    A row with a marker that has no value, or with a cell that its type can't
    hold, goes whole to the reject sink (:func:`read_rejected`, with the
    reasons) instead of the data; the batch path fails instead, which a stream can't
    do before its first row is written. A retried micro-batch overwrites its own folders.
    """
    src = _file_stream(spark, source, schema, fmt, max_files_per_trigger)
    m = _values_map(values)
    reason = "struct<column_name:string,raw:string>"
    cols, unknown = [], []
    for f in src.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            missing = is_marker(c) & F.element_at(m, marker_key(c)).isNull()
            unknown.append(F.when(missing, F.struct(F.lit(f.name).alias("column_name"), c.alias("raw")).cast(reason)))
            c = F.when(is_marker(c), F.element_at(m, marker_key(c))).otherwise(c)
        cols.append(c.alias(f.name))
    problems = F.filter(F.array(*unknown), lambda x: x.isNotNull()) if unknown else F.array().cast(f"array<{reason}>")
    resolved = src.select(*cols, problems.alias("_unknown"))
    rejected = F.lit(None).cast(f"array<{reason}>")
    if types:
        resolved = coerce_table(resolved, types, dialect)
        rejected = F.transform("_rejects", lambda r: F.struct(r["column_name"], r["raw"]).cast(reason))
    resolved = resolved.withColumn("_problems", F.concat("_unknown", F.coalesce(rejected, F.array().cast(f"array<{reason}>"))))
    extra = [c for c in ("_unknown", "_rejects") if c in resolved.columns]
    resolved = resolved.drop(*extra)
    root = out.rstrip("/")

    def split(batch: DataFrame, batch_id: int) -> None:
        good = F.size("_problems") == 0
        batch.where(good).drop("_problems").write.mode("overwrite").parquet(f"{root}/data/batch_id={batch_id}")
        batch.where(~good).write.mode("overwrite").parquet(f"{root}/rejects/batch_id={batch_id}")

    w = resolved.writeStream.option("checkpointLocation", checkpoint).foreachBatch(split)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_restored(spark: SparkSession, out: str) -> DataFrame:
    """Rows restored so far."""
    return spark.read.parquet(f"{out.rstrip('/')}/data").drop("batch_id")


def read_rejected(spark: SparkSession, out: str) -> DataFrame:
    """Rows held back so far; ``_problems`` lists column and raw cell."""
    return spark.read.parquet(f"{out.rstrip('/')}/rejects").drop("batch_id")
