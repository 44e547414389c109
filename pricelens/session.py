"""Spark session defaults and the shared scratch folder.

Everything that must survive executor loss (stream checkpoints, written
intermediate tables) goes under the folder the cluster names in
``spark.checkpoint.dir``.  A fresh local folder takes its place only where the
setting is absent and the master is local; elsewhere that is an error.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Remove checkpoint files of materialized intermediates once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # One Python worker per core: keep numpy's BLAS single-threaded there.
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
}


def get_spark(master: str | None = None, app: str = "pricelens",
              shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    ``shuffle_partitions`` should be sized to the data: about one partition
    per 128 MB of shuffled bytes on a cluster; the core count locally.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once, so that Python steps import it
    whatever folder the driver was started in.  Spark serves the archive from
    the driver, so it stays there until the driver ends."""
    sc = _context(spark)
    if sc is None or getattr(sc, "_pricelens_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    tmp = tempfile.mkdtemp(prefix="pricelens-package-")
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(os.path.join(tmp, "pricelens"), "zip", os.path.dirname(here), os.path.basename(here)))
    sc._pricelens_shipped = True


def _context(spark: SparkSession):
    """The SparkContext of a classic session (None under Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no context
        return None


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; a local one is set only if none is set and
    driver and executors are one process."""
    sc = _context(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and sc is not None:
        root = sc.getCheckpointDir()
    if not root:
        if sc is None or not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pricelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def parallelism(spark: SparkSession) -> int:
    """Cores available to tasks (shuffle partitions when unknown)."""
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder, made by Spark's own
    file system layer, so on whatever store the path names."""
    path = f"{checkpoint_root(spark)}/pricelens/{name}-{uuid.uuid4().hex[:12]}"
    sc = _context(spark)
    if sc is not None:
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).mkdirs(folder)
    return path


def materialize(df: DataFrame, how: str = "checkpoint") -> DataFrame:
    """Compute ``df`` once for several later branches.

    ``checkpoint`` writes it to the shared checkpoint folder and cuts the
    lineage (survives executor loss without recomputing upstream);
    ``none`` returns it unchanged (let each branch recompute).
    """
    if how == "none":
        return df
    if how != "checkpoint":
        raise ValueError(f"unknown materialization {how!r}")
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
