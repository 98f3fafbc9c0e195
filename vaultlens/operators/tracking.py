"""Write traces: which chunks of which region an event touches, and how a live copy converges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import io_class
from .ranges import idiv, overlap_join


def dirty_chunks(events: DataFrame, regions: DataFrame, chunk: int) -> DataFrame:
    """Distinct (region, chunk_no) that dirtying events touch.

    ``events``: dev, flags, sector, sectors. ``regions``: dev (whole device), part_dev, region, lo, hi (sectors,
    inclusive). An event on the partition's own device counts from the region's start. Reads and empty
    operations touch nothing; what reaches over a region's edge is cut. A chunk has ``chunk`` sectors.
    """
    hits = events.where(io_class(F.col("flags"), F.col("sectors")) == "dirty").select("dev", F.col("sector").alias("start"), (F.col("sector") + F.col("sectors") - 1).alias("end_incl"))
    whole = regions.select("dev", "region", "lo", "hi", F.lit(0).cast("bigint").alias("base"), F.col("lo").alias("origin"))
    part = regions.where("part_dev is not null").select(F.col("part_dev").alias("dev"), "region", F.lit(0).cast("bigint").alias("lo"), (F.col("hi") - F.col("lo")).alias("hi"), F.lit(0).cast("bigint").alias("base"), F.lit(0).cast("bigint").alias("origin"))
    met = overlap_join(hits, whole.unionByName(part), ["dev"], chunk * 64)
    span = F.sequence(idiv(F.col("clip_start") - F.col("origin"), chunk), idiv(F.col("clip_end") - F.col("origin"), chunk))
    return met.select("region", F.explode(span).alias("chunk_no")).distinct()


def coarsen(dirty: DataFrame, ratio: int) -> DataFrame:
    """Dirty chunks in units of ``ratio`` chunks."""
    return dirty.select("region", idiv("chunk_no", ratio).alias("chunk_no")).distinct()


def bitmaps(dirty: DataFrame) -> DataFrame:
    """Dirty chunks as bitmap buckets per region: bucket, bits, n_dirty."""
    return dirty.groupBy("region", F.bitmap_bucket_number("chunk_no").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("chunk_no")).alias("bits")).withColumn("n_dirty", F.bitmap_count("bits"))


def bitmap_union(maps: DataFrame) -> DataFrame:
    return maps.groupBy("region", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")).withColumn("n_dirty", F.bitmap_count("bits"))


def quiet(events: DataFrame, windows: DataFrame, cell_seconds: int = 600) -> DataFrame:
    """Dirtying events per window (dev, t0, t1, both ends inside); a window is quiet with none. Events and windows
    meet in cells of time, so a device's events aren't paired with all its windows."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    hits = events.where(io_class(F.col("flags"), F.col("sectors")) == "dirty").select("dev", micros("ts").alias("start"), micros("ts").alias("end_incl"))
    areas = windows.select("dev", "t0", "t1", micros("t0").alias("lo"), micros("t1").alias("hi"))
    met = overlap_join(hits, areas, ["dev"], cell_seconds * 1_000_000).groupBy("dev", "t0", "t1").agg(F.count("*").alias("n_writes"))
    return windows.select("dev", "t0", "t1").join(met, ["dev", "t0", "t1"], "left").na.fill(0, ["n_writes"]).withColumn("is_quiet", F.col("n_writes") == 0)


def lost(counters: DataFrame) -> DataFrame:
    """Whether any source lost events; malformed lines count too."""
    return counters.groupBy("file").agg(F.sum("n_lost").alias("n_lost")).withColumn("is_clean", F.col("n_lost") == 0)


def convergence(passes: DataFrame, by: list[str], *, freeze_seconds: float = 2.0, final_mib: float = 64.0, stalled_passes: int = 2) -> DataFrame:
    """How each live copy goes on after each of its passes.

    ``passes``: by, pass_no, dirty_mib (left to copy), read_mib and seconds (of the pass), is_held (a package lock forbids
    the freeze). The rest fits a freeze if it is at most ``final_mib`` and takes at most half of ``freeze_seconds`` at the
    pass's speed. A rest that fits is copied in the freeze (``final``), or waits while it is held. A pass stalls if it waits or
    didn't make the rest smaller; with ``stalled_passes`` of them the copy is given up. Passes after the end have no
    decision. Adds is_fit, n_stalled and decision.
    """
    line = Window.partitionBy(*by).orderBy("pass_no")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # seconds for the rest at the pass's speed, compared without a division
    fit = (F.col("dirty_mib") == 0) | ((F.col("dirty_mib") <= final_mib) & ((F.col("seconds") <= 0) | (F.col("dirty_mib") * F.col("seconds") <= F.col("read_mib") * (freeze_seconds / 2))))
    stalls = (F.col("is_fit") & F.col("is_held")) | (F.col("dirty_mib") >= F.lag("dirty_mib").over(line))
    rows = passes.withColumn("is_fit", fit)
    rows = rows.withColumn("n_stalled", F.sum(F.when(stalls, 1).otherwise(0)).over(upto).cast("int"))
    verdict = F.when(F.col("is_fit") & ~F.col("is_held"), "final").when(F.col("n_stalled") >= stalled_passes, "give_up").when(F.col("is_fit"), "wait").otherwise("again")
    ended = F.max(F.col("decision").isin("final", "give_up")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("decision", verdict).withColumn("decision", F.when(~F.coalesce(ended, F.lit(False)), F.col("decision")))


def sessions(events: DataFrame, by: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """Bursts of events at most so far apart: by, burst, started, ended, n_events."""
    line = Window.partitionBy(*by).orderBy(ts)
    late = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(line).cast("timestamp")) > gap_seconds * 1_000_000
    marked = events.withColumn("burst", F.sum(F.when(late, 1).otherwise(0)).over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*by, "burst").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_events"))
