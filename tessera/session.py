"""Session helpers: one place for the configuration every job relies on.

The library never owns the cluster; it only reads what the session says. The
shared folder used for lineage cuts and written intermediate tables comes from
``spark.checkpoint.dir``. A private folder is created only when that setting is
unset on a ``local`` master (tests, a laptop); any other master without it is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Tables of the driver test data, in the order TESTDATA.md lists them.
DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str | None = None, app: str = "tessera",
                  shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Create (or fetch) a session with the settings the operators assume.

    AQE is on so shuffle partition counts and skewed joins are re-planned at
    run time; the session time zone is UTC so timestamp text renders the same
    on every executor; the web UI stays off.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def prepare_session(spark: SparkSession) -> SparkSession:
    """Settings a caller-provided session needs: UTC session time zone (snapshot text renders and
    parses timestamps in it) and a checkpoint folder (only created when none is configured)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a private one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-")  # one machine: tests, a laptop
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/tessera-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared folder, survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_REGISTERED: dict[int, tuple[str, frozenset]] = {}


def forget_driver_views(spark: SparkSession) -> None:
    """Drop the registration cache (call after replacing temp views that share driver names)."""
    _REGISTERED.pop(id(spark), None)


def register_driver_views(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> None:
    """Temp views over the driver tables; repeated calls for the same folder in the same session
    reuse the views instead of listing files and reading footers again."""
    key = id(spark)
    done_dir, done = _REGISTERED.get(key, ("", frozenset()))
    if done_dir != sf_dir:
        done = frozenset()
    todo = [n for n in names if n not in done or not spark.catalog.tableExists(n)]
    for n in todo:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)
    _REGISTERED[key] = (sf_dir, done | frozenset(todo))


def scale_conf(input_bytes: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle and scan sizing for a job reading ``input_bytes``: about one shuffle partition per
    ``partition_bytes`` of input (AQE coalesces small ones and splits skewed ones at run time),
    file splits of the same size. Apply with ``spark.conf.set`` before running a job."""
    n = max(200, int(input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
    }


def apply_scale(spark: SparkSession, input_bytes: int, partition_bytes: int = 256 << 20) -> None:
    for k, v in scale_conf(input_bytes, partition_bytes).items():
        spark.conf.set(k, v)
