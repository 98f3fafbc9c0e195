"""A live dirty map, and the upsert of late chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import trace_event
from ..operators.tracking import dirty_chunks
from ..session import Cut


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Trace lines that arrive as text files: events, and drain markers as their number."""
    lines = spark.readStream.text(folder)
    marker = F.regexp_extract("value", r"copy-barrier-(\d+)", 1).try_cast("bigint")
    return lines.select(trace_event(F.col("value")).alias("e"), marker.alias("marker")).where("e is not null or marker is not null")


class DirtyMap:
    """Dirty chunks that a trace leaves behind, one table of distinct (region, chunk_no) per epoch.

    ``take`` swaps the map out: what came before belongs to the copy that is under way, what comes after to the
    next. Lost or malformed events make the map unusable, as a missed write can't be made good.
    """

    def __init__(self, regions: DataFrame, chunk: int):
        self.regions, self.chunk = regions, chunk
        self.parts: list[Cut] = []
        self.marker, self.malformed = -1, 0

    def add(self, batch: DataFrame, _epoch: int) -> None:
        batch = batch.persist()
        facts = batch.agg(F.max("marker").alias("m"), F.count(F.when(F.col("e.malformed"), 1)).alias("bad")).first()
        self.marker = max(self.marker, -1 if facts["m"] is None else facts["m"])
        self.malformed += facts["bad"]
        events = batch.where("e is not null and not e.malformed").select(F.concat_ws(":", "e.major", "e.minor").alias("dev"), "e.flags", "e.sector", "e.sectors")
        self.parts.append(Cut(dirty_chunks(events, self.regions, self.chunk), "dirty"))
        batch.unpersist()

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def take(self) -> DataFrame | None:
        """All dirty chunks so far; the map is empty afterwards. None if nothing came."""
        if self.malformed:
            raise ValueError(f"{self.malformed} malformed trace lines: the map isn't complete")
        parts, self.parts = self.parts, []
        out = None
        for p in parts:
            out = p.df if out is None else out.unionByName(p.df)
        return None if out is None else out.distinct()


def late_updates(spark: SparkSession, chunks: DataFrame, target: str, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Chunk versions of a stream appended to ``target``, to be read through ``newest``: nothing late is dropped."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.groupBy(*key).agg(F.max(F.struct(order, *[c for c in batch.columns if c not in (*key, order)])).alias("v")).select(*key, "v.*").write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, target: str, key: list[str], order: str) -> DataFrame:
    """The newest version of each chunk in what ``late_updates`` wrote."""
    rows = spark.read.parquet(target).drop("epoch")
    return rows.groupBy(*key).agg(F.max(F.struct(order, *[c for c in rows.columns if c not in (*key, order)])).alias("v")).select(*key, "v.*")
