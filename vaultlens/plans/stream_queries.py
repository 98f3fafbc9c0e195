"""Queries that run as streams over all that has arrived, and end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, scratch_root
from ..sources import table
from ..streaming.jobs import stall_stream
from ..streaming.tracking import DirtyMap, late_updates, newest, trace_stream
from . import range_queries as rq

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as a stream; rows of a file arrive together."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")  # a pattern, as a stream takes no single file


def stream_dirty_map(spark: SparkSession, d: str) -> DataFrame:
    """The dirty map that a stream of trace lines leaves behind."""
    io = rq._io(spark, d)
    line = F.concat(F.lit("w-1 [0] .. 1.0: block_bio_queue: 8,"), "dev", F.lit(" "), "flags", F.lit(" "), F.col("sector").cast("string"), F.lit(" + "), F.col("sectors").cast("string"), F.lit(" [w]"))
    lines = io.select(line.alias("value"))
    folder = _folder(spark, "trace")
    lines.unionByName(spark.range(1).select(F.lit("copy-barrier-1").alias("value"))).write.text(folder)
    regions = cut(rq._regions(spark).withColumn("dev", F.concat(F.lit("8:"), "dev")), "regions")
    held = DirtyMap(regions, 8)
    held.start(trace_stream(spark, folder), _folder(spark, "offsets")).awaitTermination()
    if held.marker != 1:
        raise RuntimeError("the drain marker didn't arrive")
    return held.take()


def stream_late_updates(spark: SparkSession, d: str) -> DataFrame:
    """The newest version of each chunk after all versions arrived as a stream."""
    rows = _stream(spark, d, "chunks").select("chain_id", "member_seq", "chunk_offset", F.struct("batch_no", "chunk_id").alias("version"), "plain_len")
    target = _folder(spark, "late")
    late_updates(spark, rows, target, ["chain_id", "member_seq", "chunk_offset"], "version", _folder(spark, "offsets")).awaitTermination()
    return newest(spark, target, ["chain_id", "member_seq", "chunk_offset"], "version").select("chain_id", "member_seq", "chunk_offset", F.col("version.chunk_id").alias("chunk_id"), "plain_len")


def stream_stalls(spark: SparkSession, d: str) -> DataFrame:
    """Advances and stalls of jobs, with state per job."""
    events = _stream(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("event_no"), F.col("event_type").alias("phase"), F.lit(0).cast("bigint").alias("done"))
    target = _folder(spark, "stalls")
    stall_stream(events, 8 * 3600).writeStream.format("parquet").option("path", target).option("checkpointLocation", _folder(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("job_id string, kind string, phase string, done bigint, idle_seconds double").parquet(target)


for f in (stream_dirty_map, stream_late_updates, stream_stalls):
    QUERIES[f.__name__] = f

SQL["stream_dirty_map"] = rq.SQL["dirty_chunks"]
SQL["stream_late_updates"] = "SELECT chain_id, member_seq, chunk_offset, chunk_id, plain_len FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, member_seq, chunk_offset ORDER BY batch_no DESC, chunk_id DESC) AS rn FROM chunks) WHERE rn = 1"
SQL["stream_stalls"] = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, ts, event_id, event_type AS phase, lag(event_type) OVER w AS prev, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT job_id, phase, ts, lag(phase) OVER v AS old, epoch_us(ts) - epoch_us(lag(ts) OVER v) AS gap FROM e WHERE rn = 1 OR phase IS DISTINCT FROM prev WINDOW v AS (PARTITION BY job_id ORDER BY ts, event_id))
SELECT job_id, 'advance' AS kind, phase, CAST(0 AS BIGINT) AS done, CAST(0 AS DOUBLE) AS idle_seconds FROM m UNION ALL SELECT job_id, 'stalled', old, CAST(0 AS BIGINT), CAST(gap AS DOUBLE) / 1e6 FROM m WHERE gap > 28800000000"""
