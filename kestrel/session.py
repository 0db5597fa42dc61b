"""Spark session helpers.

Everything in the library takes a ``SparkSession`` from the caller; this module
only offers a builder with sane defaults for tests and the bench, and the
checkpoint-directory rule: read ``spark.checkpoint.dir`` from the session and
only set a private one when it is unset (local tests).
"""

from __future__ import annotations

import contextlib
import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "kestrel", driver_memory: str = "16g") -> SparkSession:
    """Local session used by tests and the bench. On a cluster, the caller's
    session is used unchanged."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of
    the session, else the folder the caller gave ``setCheckpointDir``. Only a
    local session (tests) may have neither: it gets a private folder, once.
    On a cluster that is an error, as executors would write to their own disks."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir
    given = spark.sparkContext.getCheckpointDir()
    if given:
        return given
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kestrel-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame, name: str = "materialized", compression: str | None = None) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder
    and return a scan of it (never a local checkpoint, which dies with its
    executor). Parquet rather than an RDD checkpoint: columnar and
    compressed, and every later branch reads only the columns it uses with
    filters pushed into the scan. ``compression``: the session's if None."""
    import uuid
    path = shared_path(df.sparkSession, "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """The session's setting ``key`` is ``value`` inside the block, then as before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster, once an application
    (their Python workers import it by name, and it may not be installed
    there). A local session needs none."""
    import shutil
    app = spark.sparkContext.applicationId
    if app in _shipped or re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="kestrel-ship-"), "kestrel")
    spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", root, "kestrel"))
    _shipped.add(app)


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table: ``<sf_dir>/<name>.parquet``, local or remote."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    return os.path.join(checkpoint_dir(spark), *parts)


# Inputs smaller than this are recomputed rather than materialised: writing
# and re-reading a table costs more than re-running a small join. Session
# conf ``kestrel.materialize.minBytes`` overrides it.
MATERIALIZE_MIN_BYTES = 256 * 1024 * 1024


def input_bytes(df: DataFrame) -> int:
    """Sum of the sizes of the plan's leaf relations (file sizes for parquet
    scans) — known before anything runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        total += int(str(leaves.apply(i).stats().sizeInBytes()))
    return total


def materialize_if_large(df: DataFrame, name: str = "materialized") -> DataFrame:
    """``cut_lineage`` when the input is large enough for a recomputation to
    cost more than a write and a pruned re-read; otherwise ``df`` itself.
    Use it only where materialising is an optimisation, never where a
    branch needs identical rows (see ``ordering.global_ordinal``)."""
    spark = df.sparkSession
    threshold = int(spark.conf.get("kestrel.materialize.minBytes", str(MATERIALIZE_MIN_BYTES)))
    try:
        size = input_bytes(df)
    except Exception:  # noqa: BLE001 — unknown size: materialise
        size = threshold
    return cut_lineage(df, name) if size >= threshold else df
