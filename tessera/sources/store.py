"""Versioned snapshot store on a shared file system (S4, S6, S7, S8, W2 allocation).

Layout under a store root (any Hadoop-compatible URI: HDFS, S3A, ABFS, file):

    <root>/<scenario>/revisions/rNNN/tables/<table>/part-*      table data (parquet or csv)
    <root>/<scenario>/revisions/rNNN/manifest.json              written last: the revision is whole
    <root>/<scenario>/commits/NNNNNNNNNNNN                      one empty file for each committed revision; the newest is the pointer
    <root>/<scenario>/latest                                    the pointer as text, for readers that know no commits

A revision is immutable. Its tables are written by Spark jobs into a staging
folder; only when every table is written is the staging folder moved into
place, then the manifest is written, then the commit file is created. A reader that
goes through the manifest or the pointer therefore sees a revision whole or
not at all, and a failed or killed export leaves nothing visible. Commit files are only ever added,
so no writer, however late, can move the pointer back. Row counts
come from ``DataFrame.observe`` during the write, so the data is read once.

Metadata operations (list, rename, small manifest files) go through the
Hadoop FileSystem of the session, never through a machine-local folder.
"""

from __future__ import annotations

import csv
import datetime as _dt
import json
from concurrent.futures import ThreadPoolExecutor
import re
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions.render import render_cells
from tessera.sources.csv_records import csv_records

REVISION_RE = re.compile(r"r([0-9]+)")
SEGMENT_RE = re.compile(r"[A-Za-z0-9._-]+")
DATASET_SQL = "dataset.sql"  # the SQL script stored beside a revision's data


# ----------------------------------------------------------------------- file-system helpers

class FS:
    """Thin access to the session's Hadoop FileSystem for metadata operations."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _p(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._p(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return bool(self._fs(path).exists(self._p(path)))

    def mkdirs(self, path: str) -> None:
        self._fs(path).mkdirs(self._p(path))

    def claim(self, path: str) -> bool:
        """Atomically create an empty marker file; False when it already exists."""
        try:
            return bool(self._fs(path).createNewFile(self._p(path)))
        except Exception:  # an existing file raises on some stores; anything else is an error
            if self.exists(path):
                return False
            raise

    def rename(self, src: str, dst: str) -> None:
        if not self._fs(src).rename(self._p(src), self._p(dst)):
            raise OSError(f"can't rename {src} to {dst}")

    def replace(self, src: str, dst: str) -> None:
        """Rename over an existing file in one step: a reader finds the old file or the new one."""
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(options, 1)
        over[0] = options.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs(dst).makeQualified(self._p(dst)).toUri(), self._conf)
        context.rename(self._fs(src).makeQualified(self._p(src)), self._fs(dst).makeQualified(self._p(dst)), over)

    def delete(self, path: str) -> None:
        if self.exists(path):
            self._fs(path).delete(self._p(path), True)

    def list_dirs(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return [s.getPath().getName() for s in self._fs(path).listStatus(self._p(path)) if s.isDirectory()]

    def list_names(self, path: str) -> list[tuple[str, bool]]:
        """(name, whether a folder) of what is in a folder, none if it doesn't exist."""
        if not self.exists(path):
            return []
        return [(s.getPath().getName(), bool(s.isDirectory())) for s in self._fs(path).listStatus(self._p(path))]

    def list_files(self, path: str) -> list[str]:
        """Data files under a folder (or the file itself), hidden and marker files left out, sorted."""
        fs, p = self._fs(path), self._p(path)
        if not fs.getFileStatus(p).isDirectory():
            return [path]
        out, found = [], fs.listFiles(p, True)
        while found.hasNext():
            f = found.next().getPath()
            if f.getName()[:1] not in ("_", "."):
                out.append(f.toString())
        return sorted(out)

    def first_record(self, path: str) -> list[str]:
        """Cells of a CSV file's first record (which may span lines), empty for an empty file."""
        stream = self._fs(path).open(self._p(path))
        try:
            reader = self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(stream, "UTF-8"))

            def lines():
                while (line := reader.readLine()) is not None:
                    yield line + "\n"

            return next(csv.reader(lines()), [])
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Write a small file through a temporary name and a rename."""
        tmp = f"{path}.tmp-{uuid.uuid4().hex[:8]}"
        out = self._fs(tmp).create(self._p(tmp), True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        self.replace(tmp, path)

    def read_text(self, path: str) -> str | None:
        if not self.exists(path):
            return None
        stream = self._fs(path).open(self._p(path))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()


def revision_id(n: int) -> str:
    return f"r{n:03d}"


def parse_revision_id(name: str) -> int | None:
    m = REVISION_RE.fullmatch(name)
    return int(m.group(1)) if m else None


def scenario_path(scenario: str) -> str:
    """A scenario's canonical path: relative segments of letters, digits, ``.``, ``_`` and ``-``;
    repeated slashes count once. Empty, absolute and upward paths and other characters are errors."""
    name = (scenario or "").strip()
    segments = [s for s in name.split("/") if s]
    if not segments or name.startswith("/") or name.endswith("/"):
        raise ValueError(f"scenario path {scenario!r} must be relative and name at least one segment")
    for s in segments:
        if s in (".", "..") or not SEGMENT_RE.fullmatch(s):
            raise ValueError(f"scenario path {scenario!r} has the invalid segment {s!r}")
    return "/".join(segments)


def scenario_dir(root: str, scenario: str) -> str:
    return f"{root.rstrip('/')}/{scenario_path(scenario)}"


def revision_dir(root: str, scenario: str, rev: str) -> str:
    return f"{scenario_dir(root, scenario)}/revisions/{rev}"


# ----------------------------------------------------------------------- S7

def next_revision_number(fs: FS, root: str, scenario: str) -> int:
    """W2 for one scenario: max existing number + 1; names not shaped ``rNNN`` are ignored."""
    nums = [n for n in (parse_revision_id(d) for d in fs.list_dirs(f"{scenario_dir(root, scenario)}/revisions"))
            if n is not None]
    return (max(nums) if nums else 0) + 1


def write_snapshot(spark: SparkSession, root: str, scenario: str, tables: Mapping[str, DataFrame],
                   fmt: str = "parquet", schema_fingerprint: str = "", source: str = "export",
                   description: str = "", services: list[str] | None = None) -> DataFrame:
    """Write ``tables`` as a new immutable revision and return ``(table_name, row_count)``.

    Parquet keeps types (lossless); ``fmt='csv'`` writes the export text form
    (P5 rendering, header, RFC 4180 quoting) as many part files per table.
    """
    fs = FS(spark)
    while True:  # claim a revision number atomically; a concurrent writer gets the next one
        n = next_revision_number(fs, root, scenario)
        rev = revision_id(n)
        rdir = revision_dir(root, scenario, rev)
        fs.mkdirs(rdir)
        if fs.claim(f"{rdir}/_claim"):
            break
    staging = f"{rdir}/_staging-{uuid.uuid4().hex[:8]}"
    try:
        counts = _write_tables(tables, staging, fmt)
        fs.rename(staging, f"{rdir}/tables")
        manifest = {
            "scenario": scenario, "revision": rev, "schemaFingerprint": schema_fingerprint,
            "createdAt": _dt.datetime.now(_dt.timezone.utc).isoformat().replace("+00:00", "Z"),
            "source": source, "format": fmt, "tables": sorted(tables), "services": services or [],
            "rowCounts": counts, "description": description,
        }
        fs.write_text(f"{rdir}/manifest.json", json.dumps(manifest, sort_keys=False))
        commits = f"{scenario_dir(root, scenario)}/commits"
        fs.mkdirs(commits)
        fs.claim(f"{commits}/{n:012d}")
        fs.write_text(f"{scenario_dir(root, scenario)}/latest", latest_revision(spark, root, scenario) or rev)
    except Exception:
        fs.delete(staging)
        fs.delete(rdir)
        raise
    rows = [(t, counts[t]) for t in sorted(counts)]
    return spark.createDataFrame(rows, "table_name string, row_count long") if rows else \
        spark.createDataFrame([], "table_name string, row_count long")


#: Column of a table to be written that lists what is wrong with a row.
PROBLEMS = "_problems"


class BadRows(Exception):
    """A table had rows with problems; the good ones were written."""

    def __init__(self, table: str, rows: int):
        super().__init__(f"table {table}: {rows} rows with problems")
        self.table, self.rows = table, rows


def _write_one(name: str, df: DataFrame, target: str, fmt: str) -> int:
    obs = Observation(f"rows_{name}_{uuid.uuid4().hex[:6]}")
    if PROBLEMS in df.columns:  # the same pass counts the bad rows and writes the good ones
        df = df.observe(obs, F.count(F.lit(1)).alias("rows"), F.count_if(F.size(PROBLEMS) > 0).alias("bad"))
        df.where(F.size(PROBLEMS) == 0).drop(PROBLEMS).write.mode("error").parquet(target)
        if obs.get["bad"]:
            raise BadRows(name, int(obs.get["bad"]))
        return int(obs.get["rows"])
    df = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    if fmt == "csv":
        # Spark's CSV writer trims cell whitespace unless told not to; snapshot text is kept verbatim
        (render_cells(df).write.mode("error")
         .option("header", True).option("escape", '"').option("quoteAll", False)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("emptyValue", "").csv(target))
    else:
        df.write.mode("error").parquet(target)
    return int(obs.get["rows"])


def _write_tables(tables: Mapping[str, DataFrame], base: str, fmt: str, parallel: int = 4) -> dict[str, int]:
    """Write every table under ``base`` as concurrent Spark jobs (small tables then share the
    cluster instead of running one after another); row counts observed during the writes."""
    names = sorted(tables)
    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(names)))) as pool:
        futures = {n: pool.submit(_write_one, n, tables[n], f"{base}/{n}", fmt) for n in names}
        return {n: futures[n].result() for n in names}


# ----------------------------------------------------------------------- reading revisions

def read_manifest(spark: SparkSession, root: str, scenario: str, rev: str) -> dict | None:
    text = FS(spark).read_text(f"{revision_dir(root, scenario, rev)}/manifest.json")
    return json.loads(text) if text else None


def update_manifest(spark: SparkSession, root: str, scenario: str, rev: str, **fields) -> None:
    """Replace fields of a committed revision's manifest; its tables stay as they are."""
    manifest = read_manifest(spark, root, scenario, rev) or {}
    FS(spark).write_text(f"{revision_dir(root, scenario, rev)}/manifest.json", json.dumps(manifest | fields))


def latest_revision(spark: SparkSession, root: str, scenario: str) -> str | None:
    """The newest committed revision; of a store without commit files, what its ``latest`` file says."""
    fs = FS(spark)
    numbers = [int(name) for name, _ in fs.list_names(f"{scenario_dir(root, scenario)}/commits") if name.isdigit()]
    if numbers:
        return revision_id(max(numbers))
    text = fs.read_text(f"{scenario_dir(root, scenario)}/latest")
    return text.strip() if text else None


def resolve(spark: SparkSession, root: str, scenario: str, revision: str | None = None) -> tuple[str, dict]:
    """W1 for one request: explicit revision, else the ``latest`` pointer; distinct errors for a
    missing scenario, a scenario without revisions and an unknown revision."""
    fs = FS(spark)
    if not fs.exists(scenario_dir(root, scenario)):
        raise LookupError(f"scenario {scenario!r} not found")
    rev = revision or latest_revision(spark, root, scenario)
    if not rev:
        raise LookupError(f"scenario {scenario!r} has no revisions")
    m = read_manifest(spark, root, scenario, rev)
    if m is None:
        raise LookupError(f"revision {rev!r} not found in scenario {scenario!r}")
    return rev, m


def read_revision(spark: SparkSession, root: str, scenario: str, revision: str | None = None) -> dict[str, DataFrame]:
    """Tables of a committed revision (only tables listed in its manifest)."""
    rev, m = resolve(spark, root, scenario, revision)
    base = f"{revision_dir(root, scenario, rev)}/tables"
    out = {}
    for t in m["tables"]:
        if m.get("format", "parquet") == "csv":
            out[t] = read_csv_table(spark, f"{base}/{t}")
        else:
            out[t] = spark.read.parquet(f"{base}/{t}")
    return out


# ----------------------------------------------------------------------- S1

CORRUPT = "_corrupt_record"
_NULL_SENTINEL = "\u0001<null>\u0001"


def read_csv_table(spark: SparkSession, path: str) -> DataFrame:
    """S1 scan: text columns bound by header name, file by file (RFC 4180 quotes, multi-line cells), plus
    ``_corrupt_record`` for ragged rows. A file of any size is read by many tasks (:mod:`csv_records`). Every empty
    cell reads as ``""`` (trap Q3: Spark reads an unquoted empty cell as null, the source reads it as an empty string)."""
    frames = [_parsed(records, header) for header, records in sorted(csv_records(spark, path, FS(spark).first_record), key=lambda x: x[0])]
    if not frames:
        raise LookupError(f"no CSV files under {path!r}")
    out = frames[0]
    for f in frames[1:]:  # a column that some files lack reads as empty there
        out = out.unionByName(f, allowMissingColumns=True)
    names = [c for c in out.columns if c != CORRUPT]
    return out.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names], CORRUPT)


def _parsed(records: DataFrame, header: list[str]) -> DataFrame:
    """Cells of whole records."""
    schema = ", ".join(f"`{c}` string" for c in header) + f", `{CORRUPT}` string"
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE",
               "columnNameOfCorruptRecord": CORRUPT, "nullValue": _NULL_SENTINEL, "emptyValue": ""}
    cells = records.select(F.from_csv("text", schema, options).alias("r")).select("r.*")
    return cells.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in header], CORRUPT)


def read_snapshot(spark: SparkSession, path: str, table: str, types: Mapping[str, str],
                  dialect: str = "postgres") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read one CSV table, type it (P1/P2) and report problems.

    Returns (typed table, rejects, warnings). Warnings hold header columns
    missing from the schema (bound by name, so they are ignored), schema
    columns missing from the header, and ragged rows (the raw line).
    """
    from tessera.functions.coerce import coerce_table

    raw = read_csv_table(spark, path)
    header = [c for c in raw.columns if c != CORRUPT]
    unknown = [c for c in header if c not in types]
    good = raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    typed = coerce_table(good, {c: t for c, t in types.items() if c in header}, dialect)
    rejects = (typed.where(F.size("_rejects") > 0).select(F.explode("_rejects").alias("r"))
               .select(F.lit(table).alias("table_name"), "r.column_name", "r.raw"))
    missing = [c for c in types if c not in header]  # schema columns the file does not carry
    warn_cols = spark.createDataFrame([(table, "unknown_column", c) for c in unknown]
                                      + [(table, "missing_column", c) for c in missing],
                                      "table_name string, kind string, detail string")
    # the first data column stays referenced (as an empty suffix, in the filter so that counts keep
    # it too): Spark refuses a scan that reads only the corrupt-record column
    flagged = F.concat(F.col(CORRUPT), F.substring(F.col(header[0]), 1, 0))
    ragged = raw.where(flagged.isNotNull()).select(
        F.lit(table).alias("table_name"), F.lit("ragged_row").alias("kind"), flagged.alias("detail"))
    return typed.drop("_rejects"), rejects, warn_cols.unionByName(ragged)


# ----------------------------------------------------------------------- S6

# Fixed value: preview rows unless asked otherwise.
PREVIEW_DEFAULT = 5


def preview_snapshot(tables: Mapping[str, DataFrame], order_by: Mapping[str, list[str]] | None = None,
                     n: int = PREVIEW_DEFAULT) -> DataFrame:
    """Per table the first ``n`` rows as whole export text lines, the exact row count, ``truncated``
    (the table has more rows than shown) and the bytes of the table's files. Counts are data
    rows (the source counted raw lines, header included).

    With ``order_by`` the first rows are the smallest keys (a distributed
    top-k), otherwise the first rows in file order.
    """
    if int(n) < 1:
        raise ValueError("a preview needs at least one row")
    frames = []
    for name in sorted(tables):
        df = tables[name]
        keys = (order_by or {}).get(name)
        head = df.orderBy(*keys).limit(n) if keys else df.limit(n)
        rows = df.count()  # Parquet answers from the footers
        text = render_cells(head)
        line = F.concat_ws(",", *[F.col(c) for c in text.columns])
        frames.append(text.select(
            F.lit(name).alias("table_name"), line.alias("row_text"),
            F.lit(rows).cast("long").alias("row_count"), F.lit(rows > n).alias("truncated"),
            F.lit(_input_bytes(df)).cast("long").alias("bytes")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _input_bytes(df: DataFrame) -> int | None:
    """Total size of the files a file-based DataFrame reads (file-system metadata, no data read)."""
    try:
        files = df.inputFiles()
    except Exception:  # noqa: BLE001 - not file based
        return None
    if not files:
        return None
    fs = FS(df.sparkSession)
    return int(sum(fs._fs(f).getFileStatus(fs._p(f)).getLen() for f in files))


# ----------------------------------------------------------------------- S4

def read_revision_catalog(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Every revision manifest under ``root`` as a ``revisions`` DataFrame, plus the bad ones.

    Folders are walked level by level, several at a time, down to the revisions; a revision's own folder is listed, its tables never
    are, so the work grows with the revisions and not with their data files. Manifests are read in one distributed
    JSON scan (multi-line, permissive). Unreadable manifests are returned in the second frame with
    their path and error text, never aborting the walk.
    """
    root = root.rstrip("/")
    found = _revision_folders(FS(spark), root)
    listed = spark.createDataFrame([(f"{scenario}/revisions/{rev}", scenario, rev, has_sql) for scenario, rev, has_sql in found],
                                   "place string, path_scenario string, revision string, has_sql boolean")
    schema = ("scenario string, revision string, schemaFingerprint string, createdAt string, source string, "
              "format string, tables array<string>, services array<string>, rowCounts map<string,bigint>, "
              "description string, remoteId string, remoteUpdatedAt string, _corrupt_record string")
    paths = [f"{root}/{scenario}/revisions/{rev}/manifest.json" for scenario, rev, _ in found]
    df = (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT).json(paths) if paths else spark.createDataFrame([], schema))
    # the folder below the root, as the walk names it
    path = F.col("_metadata.file_path") if paths else F.lit("")
    df = df.withColumn("_path", F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).drop("revision")
    df = df.withColumn("place", F.regexp_extract("_path", re.escape(root.split("://")[-1]) + "/(.*)/manifest\\.json$", 1)).join(listed, "place")
    good = df.where(F.col(CORRUPT).isNull()).select(
        F.coalesce("scenario", "path_scenario").alias("scenario"), "revision",
        F.regexp_extract("revision", "r([0-9]+)", 1).cast("long").alias("n"),
        F.col("schemaFingerprint").alias("schema_fingerprint"),
        F.try_to_timestamp("createdAt").alias("created_at"), "source", "tables",
        F.col("rowCounts").alias("row_counts"), "description",
        F.col("remoteId").alias("remote_id"), F.col("remoteUpdatedAt").alias("remote_updated_at"), "has_sql")
    # a data field stays referenced next to the corrupt-record column (Spark refuses scans of that
    # column alone)
    corrupt = F.concat(F.col(CORRUPT), F.substring(F.coalesce(F.col("scenario"), F.lit("")), 1, 0))
    bad = df.where(corrupt.isNotNull()).select(F.col("_path").alias("path"), F.lit("unreadable manifest").alias("error"))
    return good, bad


def _revision_folders(fs: FS, root: str) -> list[tuple[str, str, bool]]:
    """(scenario, revision, whether it has a SQL script) of every revision with a manifest."""
    out: list[tuple[str, str, bool]] = []
    level = [""]
    with ThreadPoolExecutor(max_workers=16) as pool:
        while level:
            below = []
            names = list(pool.map(lambda p: fs.list_names(f"{root}/{p}".rstrip("/")), level))
            for place, found in zip(level, names, strict=True):
                folders = [n for n, is_dir in found if is_dir and n[:1] not in ("_", ".")]
                if place.endswith("/revisions"):
                    revs = [r for r in folders if parse_revision_id(r)]
                    inside = pool.map(lambda r, place=place: {n for n, _ in fs.list_names(f"{root}/{place}/{r}")}, revs)
                    out += [(place.removesuffix("/revisions"), r, DATASET_SQL in files) for r, files in zip(revs, inside, strict=True) if "manifest.json" in files]
                else:
                    below += [f"{place}/{n}".lstrip("/") for n in folders if n != "commits"]
            level = below
    return sorted(out)


# ----------------------------------------------------------------------- S8 publish

def publish_tables(spark: SparkSession, target: str, tables: Mapping[str, DataFrame],
                   verify: Callable[[Mapping[str, DataFrame]], None] | None = None) -> tuple[str, dict[str, int]]:
    """Replace every table of ``target`` at once: write all into a fresh version folder, then flip
    ``<target>/_current``. Readers resolve the pointer, so they see the old set or the new set. ``verify``
    gets the written tables before the flip and raises to stop it; rows with problems (:data:`PROBLEMS`) raise :class:`BadRows`."""
    fs = FS(spark)
    version = f"v-{_dt.datetime.now(_dt.timezone.utc).strftime('%Y%m%d%H%M%S')}-{uuid.uuid4().hex[:8]}"
    vdir = f"{target.rstrip('/')}/{version}"
    try:
        counts = _write_tables(tables, vdir, "parquet")
        if verify:
            verify({t: spark.read.parquet(f"{vdir}/{t}") for t in tables})
        fs.write_text(f"{vdir}/_tables.json", json.dumps({"tables": sorted(tables), "rowCounts": counts}))
        fs.write_text(f"{target.rstrip('/')}/_current", version)
    except Exception:
        fs.delete(vdir)
        raise
    return version, counts


def read_published(spark: SparkSession, target: str, table: str) -> DataFrame:
    version = FS(spark).read_text(f"{target.rstrip('/')}/_current")
    if not version:
        raise LookupError(f"nothing published under {target!r}")
    return spark.read.parquet(f"{target.rstrip('/')}/{version.strip()}/{table}")
