"""Session helpers: building a session, and where lineage cuts are written."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quarry"):
    """A local session for tests and the benchmark (UI off, AQE on, Arrow on)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Uses the cluster's ``spark.checkpoint.dir``. Only a local-mode session
    without one (tests, a laptop) gets a fresh temporary folder; on a cluster a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on the cluster")
        conf_dir = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{os.urandom(6).hex()}")


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_freed(spark: SparkSession):
    """The shuffle files of a write made inside go as soon as it is done, not
    when the driver's garbage collector finds them; nothing reads them again."""
    return _conf(spark, _FREE_SHUFFLES, "true")


def buckets_side_by_side(spark: SparkSession, count: int):
    """Partitioned writes made inside keep the files of up to ``count``
    partitions of a task open and the rows' order; Spark sorts no row again."""
    return _conf(spark, "spark.sql.maxConcurrentOutputFileWriters", str(count))


def packed(df: DataFrame) -> DataFrameWriter:
    """Writer of tables that are kept: what is written is compressed well."""
    return df.write.option("compression", "zstd")


def write_table(df: DataFrame, path: str) -> None:
    """``df`` as parquet under ``path``; only the table stays on disk."""
    with shuffles_freed(df.sparkSession):
        packed(df).parquet(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in every Python worker (what ``--py-files``
    does at submit time): zip the package's ``.py`` files once per
    application and hand the zip to ``SparkContext.addPyFile``, which serves
    it to the executors. Functions sent to workers (``mapInPandas`` bodies,
    pandas UDFs) are pickled by reference to this package."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="quarry-pyfiles-"), "quarry.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
