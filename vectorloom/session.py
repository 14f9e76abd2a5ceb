"""Session construction and the shared scratch location.

Scratch data (checkpoints, written run tables) always goes under the folder
the cluster names in ``spark.checkpoint.dir``. Only a local-mode session with
no such setting (tests, a laptop) gets a fresh temporary folder; a cluster
session without it is an error, because a machine-local folder would not
survive the loss of an executor.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "vectorloom", conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    merged = dict(DEFAULT_CONF)
    merged["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    merged.update(conf or {})
    for key, value in merged.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_scratch(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vectorloom`` importable in the Python workers, once per application.

    Task closures (encoders, training epochs, scatter functions) refer to
    functions of this package by module, so every executor must be able to
    import it. The package is zipped on the driver and added with
    ``addPyFile``, the same mechanism as ``spark-submit --py-files``: Spark
    serves the file and puts it on each worker's path.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, archive = tempfile.mkstemp(prefix="vectorloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(archive)
    _SHIPPED.add(app)


def ensure_scratch(spark: SparkSession) -> str:
    """Return the checkpoint folder, creating one only for local sessions."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) so checkpoints and run tables survive executor loss")
    local = tempfile.mkdtemp(prefix="vectorloom-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path for a written table under the shared scratch folder."""
    base = ensure_scratch(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def local_dir_of(path: str) -> str:
    """Strip a ``file:`` scheme so local tests can inspect written files."""
    return path[len("file:"):] if path.startswith("file:") else path
