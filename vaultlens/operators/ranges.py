"""Interval algebra over inclusive ranges (start, end_incl), per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def idiv(a: Column | str, b: int) -> Column:
    """Whole quotient in 64-bit integers: offsets may exceed what a double holds exactly. ``a`` isn't negative."""
    return F.call_function("div", F.col(a) if isinstance(a, str) else a, F.lit(b).cast("bigint"))


def _line(by: list[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def merge_ranges(df: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping and adjacent ranges of each group become one. Reversed and null ranges are left out.

    Columns: by, start, end_incl. One sort per group; give a group per device or file, never one for everything.
    """
    line = _line(by).orderBy("start", "end_incl")
    rows = df.where("start is not null and end_incl >= start").select(*by, F.col("start").cast("bigint").alias("start"), F.col("end_incl").cast("bigint").alias("end_incl"))
    reach = rows.withColumn("reach", F.max("end_incl").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    # equal ranges have one order only if the reach, which never falls along the line, is part of it
    again = _line(by).orderBy("start", "end_incl", "reach").rowsBetween(Window.unboundedPreceding, 0)
    isles = reach.withColumn("isle", F.sum(F.when(F.col("start") <= F.col("reach") + 1, 0).otherwise(1)).over(again))
    return isles.groupBy(*by, "isle").agg(F.min("start").alias("start"), F.max("end_incl").alias("end_incl")).drop("isle")


def range_violations(df: DataFrame, by: list[str]) -> DataFrame:
    """Ranges a strict list may not hold: reversed, or overlapping an earlier one. Column check_id tells which."""
    line = _line(by).orderBy("start", "end_incl")
    before = F.max("end_incl").over(line.rowsBetween(Window.unboundedPreceding, -1))
    bad = F.when(F.col("end_incl") < F.col("start"), "reversed").when(F.col("start") <= before, "overlap")
    return df.select(*by, "start", "end_incl", bad.alias("check_id")).where(F.col("check_id").isNotNull())


def complement(df: DataFrame, by: list[str], low: Column, high: Column) -> DataFrame:
    """What the ranges of each group leave free between ``low`` and ``high`` (inclusive), which are functions of the group."""
    merged = merge_ranges(df, by).select(*by, "start", "end_incl", low.alias("lo"), high.alias("hi")).where("end_incl >= lo and start <= hi")
    line = _line(by).orderBy("start")
    gaps = merged.select(*by, F.coalesce(F.lag("end_incl").over(line) + 1, F.col("lo")).alias("start"), (F.col("start") - 1).alias("end_incl"))
    tails = merged.groupBy(*by).agg((F.max("end_incl") + 1).alias("start"), F.max("hi").alias("end_incl"))
    return gaps.unionByName(tails).where("start <= end_incl")


def scale(df: DataFrame, unit: int) -> DataFrame:
    """Ranges of blocks as ranges of bytes."""
    return df.withColumn("start", F.col("start") * unit).withColumn("end_incl", (F.col("end_incl") + 1) * unit - 1)


def align(df: DataFrame, unit: int, size: Column, by: list[str]) -> DataFrame:
    """Ranges widened to whole chunks, cut at the device's end, merged. Ranges beyond the end vanish."""
    first = idiv("start", unit) * unit
    last = F.least((idiv("end_incl", unit) + 1) * unit, size) - 1
    return merge_ranges(df.withColumn("start", first).withColumn("end_incl", last.cast("bigint")), by)


def chunk_plan(df: DataFrame, unit: int, by: list[str]) -> DataFrame:
    """Reads of at most ``unit`` bytes that cover chunk-aligned ranges: chunk_index, plan_offset, plan_len (the last one short)."""
    pos = F.explode(F.sequence("start", "end_incl", F.lit(unit)))
    return df.select(*by, "end_incl", pos.alias("plan_offset")).select(*by, idiv("plan_offset", unit).alias("chunk_index"), "plan_offset", F.least(F.lit(unit), F.col("end_incl") - F.col("plan_offset") + 1).alias("plan_len"))


def totals(df: DataFrame, unit: int, by: list[str]) -> DataFrame:
    """Covered bytes and planned chunks per group of merged ranges."""
    n = F.col("end_incl") - F.col("start") + 1
    return df.groupBy(*by).agg(F.count("*").alias("n_ranges"), F.sum(n).alias("covered_bytes"), F.sum(idiv(n + unit - 1, unit)).alias("planned_chunks"))


def index_gaps(df: DataFrame, by: list[str], index: str) -> DataFrame:
    """Indexes from 0 to the largest one that no row mentions (unused ones), as ranges first_missing, last_missing:
    an index may be as large as any number, so they are never listed one by one."""
    seen = df.where(F.col(index).isNotNull()).select(*by, F.col(index).alias("i")).distinct()
    prev = F.coalesce(F.lag("i").over(_line(by).orderBy("i")), F.lit(-1))
    return seen.select(*by, (prev + 1).alias("first_missing"), (F.col("i") - 1).alias("last_missing")).where("first_missing <= last_missing")


def overlap_join(points: DataFrame, areas: DataFrame, on: list[str], width: int) -> DataFrame:
    """Pairs of ranges (start, end_incl) and areas (lo, hi) that overlap, clipped to the area.

    Both sides are cut into cells of ``width``; only ranges in the same cell meet, and a pair
    counts in the first cell they share. So the join is an equi-join that shuffles by cell, whatever
    either side's size.
    """
    cell = lambda a, b: F.explode(F.sequence(idiv(a, width), idiv(b, width)))
    p = points.where("end_incl >= start").withColumn("cell", cell("start", "end_incl"))
    a = areas.where("hi >= lo").withColumn("cell", cell("lo", "hi"))
    both = p.join(a, [*on, "cell"]).where("start <= hi and end_incl >= lo").where(F.col("cell") == idiv(F.greatest("start", "lo"), width))
    return both.drop("cell").withColumn("clip_start", F.greatest("start", "lo")).withColumn("clip_end", F.least("end_incl", "hi"))


def hole_violations(df: DataFrame, key: list[str], holes: str, offset: str, length: str, size: str) -> DataFrame:
    """Holes that are empty, unordered, overlapping or beyond the end of their file."""
    each = df.select(*key, F.col(size).alias("size"), F.posexplode(holes).alias("pos", "hole")).select(*key, "size", "pos", F.col(f"hole.{offset}").alias("o"), F.col(f"hole.{length}").alias("n"))
    end = F.lag(F.col("o") + F.col("n")).over(Window.partitionBy(*key).orderBy("pos"))
    bad = F.when(F.col("n") <= 0, "empty").when(F.col("o") < F.coalesce(end, F.lit(0)), "order").when(F.col("o") + F.col("n") > F.col("size"), "beyond_end")
    return each.select(*key, "pos", bad.alias("check_id")).where(F.col("check_id").isNotNull())


def data_ranges(df: DataFrame, key: list[str], holes: str, offset: str, length: str, size: str) -> DataFrame:
    """Parts of each file that are written: the file without its holes (holes must be in order)."""
    spans = df.where(F.col(size) > 0).select(*key, F.col(size).alias("size"), F.coalesce(F.transform(holes, lambda h: F.struct(h[offset].alias("o"), h[length].alias("n"))), F.array().cast("array<struct<o:bigint,n:bigint>>")).alias("h"))
    ends = F.concat(F.array(F.struct(F.lit(0).cast("bigint").alias("o"), F.lit(0).cast("bigint").alias("n"))), F.col("h"), F.array(F.struct(F.col("size").alias("o"), F.lit(0).cast("bigint").alias("n"))))
    rows = spans.select(*key, "size", ends.alias("e")).select(*key, F.explode(F.transform(F.sequence(F.lit(1), F.size("e") - 1), lambda i: F.struct((F.col("e")[i - 1]["o"] + F.col("e")[i - 1]["n"]).alias("start"), (F.col("e")[i]["o"] - 1).alias("end_incl")))).alias("r"))
    return rows.select(*key, "r.start", "r.end_incl").where("start <= end_incl")
