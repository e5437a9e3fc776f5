"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. UTC so that TIMESTAMP literals and the oracle agree;
# AQE for runtime re-planning (partition coalescing, skew-join splitting).
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pages can be MiBs each: keep Arrow batches small so one batch fits a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "pagemill") -> SparkSession:
    """Builder used by tests, bench and scripts. On a cluster, the cluster's own
    session is used instead and only ``SESSION_DEFAULTS`` that are unset are applied."""
    builder = SparkSession.builder.master(master).appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", "8g")
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_defaults(spark)
    return spark


def ensure_defaults(spark: SparkSession) -> None:
    """Apply ``SESSION_DEFAULTS`` only where the session leaves them unset, and make the
    package importable on the executors' Python workers."""
    for k, v in SESSION_DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    ship_package(spark)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Distribute this package to the Python workers (``addPyFile`` of a zip built once
    per Spark context under the checkpoint folder). Arrow passes and pandas UDFs pickle
    functions by module reference, so workers must be able to import ``pagemill``."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    ckpt = checkpoint_dir(spark)
    if "://" in ckpt and not ckpt.startswith("file:"):
        # shared storage is not a local path: stage the zip on the driver; Spark serves it
        target = tempfile.mkdtemp(prefix="pagemill-pyfiles-")
    else:
        target = os.path.join(ckpt.replace("file:", ""), "pyfiles")
        os.makedirs(target, exist_ok=True)
    zpath = os.path.join(target, f"pagemill-{key}.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names shared storage and is always used as is. Only when
    it is unset (tests, local runs) do we pick a folder of our own; on a cluster that
    would be a machine-local folder, so there an unset setting is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="pagemill-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint): survives
    executor loss because the data lives on shared storage, not on executor disks."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in whatever file system its path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files of a folder, in whatever file system it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)
