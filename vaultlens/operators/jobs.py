"""Job event streams: last state, stalls, throttled progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_state(events: DataFrame, key: list[str], ts: str, order: str, values: list[str]) -> DataFrame:
    """The last event of each job; of equal times the larger ``order``."""
    return events.groupBy(*key).agg(F.max(F.struct(ts, order, *values)).alias("e")).select(*key, "e.*")


def numbered(events: DataFrame, key: list[str], ts: str, order: str) -> DataFrame:
    """Events numbered from 1 within their job."""
    return events.withColumn("event_no", F.row_number().over(Window.partitionBy(*key).orderBy(ts, order)))


def stalls(events: DataFrame, key: list[str], ts: str, order: str, marks: list[str], seconds: int) -> DataFrame:
    """Times without advance: an event advances if any of ``marks`` differs from the one before. Stretches
    between two advances longer than ``seconds``: key, stalled_from, stalled_until."""
    line = Window.partitionBy(*key).orderBy(ts, order)
    moved = F.lag(order).over(line).isNull()
    for m in marks:
        moved = moved | ~F.col(m).eqNullSafe(F.lag(m).over(line))
    steps = events.withColumn("moved", moved).where("moved")
    gap = steps.select(*key, F.lag(ts).over(line).alias("stalled_from"), F.col(ts).alias("stalled_until"))
    return gap.where(F.unix_micros(F.col("stalled_until").cast("timestamp")) - F.unix_micros(F.col("stalled_from").cast("timestamp")) > seconds * 1_000_000)


def _throttle(batches: Iterator[pd.DataFrame], step: int) -> Iterator[pd.DataFrame]:
    last_job, told = None, 0
    for pdf in batches:
        keep = []
        for job, done, total in zip(pdf["job_id"], pdf["done"], pdf["total"]):
            if job != last_job:
                last_job, told = job, 0
            emit = done - told >= step or (done == total and done > told)
            if emit:
                told = done
            keep.append(emit)
        yield pdf[keep]


def throttled(events: DataFrame, step: int) -> DataFrame:
    """Progress (job_id, event_no, done, total) told only after ``step`` more bytes since what was told last,
    and at the end. A fold: what is told depends on what was told before, so jobs are sorted within tasks and streamed."""
    rows = events.select("job_id", "event_no", "done", "total")
    return rows.repartition("job_id").sortWithinPartitions("job_id", "event_no").mapInPandas(lambda it: _throttle(it, step), rows.schema)


def stale(leases: DataFrame, now: int) -> DataFrame:
    """Leases that expired: ttl 0 never does."""
    return leases.where((F.col("ttl") != 0) & (F.lit(now) > F.col("created") + F.col("ttl")))
