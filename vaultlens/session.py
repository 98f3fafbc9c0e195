"""Session settings and the shared scratch area in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "vaultlens", cpus: str = "8") -> SparkSession:
    """A session for local runs; on a cluster the submitted settings win."""
    return (
        SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{cpus}]"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the master is
    local (tests) a temporary folder of this machine is made and set as checkpoint folder; on
    a cluster a missing setting is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="vaultlens-")
            spark.sparkContext.setCheckpointDir(base)
        _ROOTS[app] = f"{base.rstrip('/')}/vaultlens-{uuid.uuid4().hex}"
        atexit.register(_remove_quietly, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may be gone already
        pass


def path(spark: SparkSession, name: str) -> tuple:
    """A path of Hadoop's file system layer, and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, name: str) -> None:
    """Delete a folder through Hadoop's file system layer."""
    target, fs = path(spark, name)
    fs.delete(target, True)


class Cut:
    """A table written once to the shared scratch folder and read back.

    This cuts lineage like ``checkpoint()``, computes the plan once only, survives the
    loss of executors and keeps column pruning for the readers. ``drop`` frees the
    disk as soon as nothing reads the table any more.
    """

    def __init__(self, df: DataFrame, name: str = "t"):
        self.spark = df.sparkSession
        self.path = f"{scratch_root(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        schema = df.schema
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """``Cut`` for a table that stays until the session ends."""
    return Cut(df, name).df
