"""Publishing tables: once, by replacement, and as an append-only ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fs(df: DataFrame, path: str):
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish_once(df: DataFrame, path: str) -> bool:
    """Write beside the target, then rename; False if the target is there already (nothing is changed)."""
    target, fs = _fs(df, path)
    if fs.exists(target):
        return False
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    source, _ = _fs(df, staging)
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        return False
    return True


def replace(df: DataFrame, path: str) -> None:
    """Write beside the target, move the old aside, rename, then drop the old."""
    target, fs = _fs(df, path)
    tag = uuid.uuid4().hex
    df.write.parquet(f"{path}.staging-{tag}")
    old = _fs(df, f"{path}.old-{tag}")[0]
    had = fs.exists(target) and fs.rename(target, old)
    if not fs.rename(_fs(df, f"{path}.staging-{tag}")[0], target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{path} could not be replaced")
    if had:
        fs.delete(old, True)


def append_new(df: DataFrame, path: str, key: list[str]) -> int:
    """Append rows whose key the ledger doesn't hold; repeated keys in ``df`` count once. Returns how many."""
    target, fs = _fs(df, path)
    fresh = df.dropDuplicates(key)
    if fs.exists(target):
        fresh = fresh.join(df.sparkSession.read.parquet(path).select(*key), key, "left_anti")
    batch = f"{path}/batch={uuid.uuid4().hex}"
    fresh.write.parquet(batch)
    return df.sparkSession.read.parquet(batch).count()


def as_report(df: DataFrame, mode: str) -> DataFrame:
    """Rows as JSON reports that name their mode."""
    return df.select(F.to_json(F.struct(F.lit(mode).alias("mode"), *df.columns)).alias("report"))
