"""Session helpers: the settings the library relies on, and a shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the plans assume. AQE re-plans joins from runtime sizes, coalesces
# small shuffle partitions and splits skewed ones (hot terms, hot queries).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Streaming state without a watermark (seen files, df per term) grows with
    # the collection: keep it in RocksDB rather than on the JVM heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_spark(master: str | None = None, app: str = "hearsay", **conf: str) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    On a cluster ``master`` stays ``None`` and the launcher decides. Extra
    keyword settings use underscores for dots: ``spark_sql_shuffle_partitions``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables and stream state.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only
    when neither is set and the master is local (tests), a fresh local folder
    is made and registered, so later calls agree; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="hearsay-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder name under the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder and all in it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def local_path(path: str) -> str:
    """``file:/x`` → ``/x`` for paths handed to the local file system."""
    return path[len("file:"):] if path.startswith("file:") else path


def default_parallelism(spark: SparkSession) -> int:
    try:
        return int(spark.sparkContext.defaultParallelism or os.cpu_count() or 1)
    except Exception:  # noqa: BLE001  (no SparkContext view, e.g. Spark Connect)
        return int(spark.conf.get("spark.sql.shuffle.partitions", "8"))


def ship_package(spark: SparkSession) -> None:
    """Make ``hearsay`` importable in Python workers (for ``mapInPandas``).

    Zips the package once per application into a temporary folder of the driver
    and registers it with ``addPyFile``, which serves it to the executors; a
    no-op when already importable there (e.g. installed on the cluster image
    and marked so in the conf).
    """
    if spark.conf.get("spark.hearsay.packageShipped", "false") == "true":
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="hearsay-pkg-")
    archive = shutil.make_archive(os.path.join(out, "hearsay"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="hearsay")
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("spark.hearsay.packageShipped", "true")
