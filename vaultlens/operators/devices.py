"""Devices, partitions and mounts as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_identities(df: DataFrame, device: str, ids: list[str]) -> DataFrame:
    """Devices that share an identity with another: one equi-group per identity column, compared without case.

    Empty and null identities match nothing. Columns: kind, identity, n_devices, first_device. No pairs are built."""
    each = df.select(F.col(device).alias("device"), F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.lower(F.col(c)).alias("identity")) for c in ids])).alias("i")).select("device", "i.*").where("identity <> ''")
    return each.groupBy("kind", "identity").agg(F.countDistinct("device").alias("n_devices"), F.min("device").alias("first_device")).where("n_devices > 1")


def nested_unmounted(subvolumes: DataFrame, mounted: DataFrame, by: list[str]) -> DataFrame:
    """Paths below a mounted path that aren't mounted themselves. Every ancestor of a path is a key, so it is an equi-join."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = subvolumes.join(mounted.select(*by, "path"), [*by, "path"], "left_anti").where(F.size(parts) > 1)
    lines = rows.select(*by, "path", F.explode(above).alias("parent"))
    return lines.join(mounted.select(*by, F.col("path").alias("parent")), [*by, "parent"], "left_semi").select(*by, "path").distinct()


def hierarchy_order(devices: DataFrame) -> DataFrame:
    """Disks by name, each followed by its partitions by number: position over (parent or name, number)."""
    root = F.coalesce("parent", "name")
    inner = F.row_number().over(Window.partitionBy(root).orderBy(F.col("number").asc_nulls_first()))
    return devices.withColumn("disk", root).withColumn("place", inner)


def merged_mountpoints(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """All mount points of a device from several sources, distinct and sorted."""
    each = df.select(*by, F.explode(F.array(*columns)).alias("mount")).where("mount is not null").distinct()
    return each.groupBy(*by).agg(F.array_sort(F.collect_list("mount")).alias("mountpoints"))


def layout_difference(a: DataFrame, b: DataFrame, by: list[str], order: list[str], compared: list[str]) -> DataFrame:
    """First position at which two layouts differ, region by region."""
    at = lambda d: d.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).alias("pos"), F.struct(*compared).alias("r"))
    both = at(a).alias("a").join(at(b).alias("b"), [*by, "pos"], "full_outer").where(~F.col("a.r").eqNullSafe(F.col("b.r")))
    return both.groupBy(*by).agg(F.min("pos").alias("first_difference"))


def unallocated(regions: DataFrame, by: list[str], size: Column, least: float = 0.02) -> DataFrame:
    """Gaps between regions (start, end_incl) of at least that share of the disk; the cursor only moves ahead."""
    line = Window.partitionBy(*by).orderBy("start", "end_incl").rowsBetween(Window.unboundedPreceding, -1)
    rows = regions.withColumn("size", size)
    gaps = rows.select(*by, "size", F.coalesce(F.max("end_incl").over(line) + 1, F.lit(0)).alias("gap_start"), (F.col("start") - 1).alias("gap_end"))
    tail = rows.groupBy(*by).agg(F.max("size").alias("size"), (F.max("end_incl") + 1).alias("gap_start"), (F.max("size") - 1).alias("gap_end"))
    return gaps.unionByName(tail).where((F.col("gap_end") >= F.col("gap_start")) & (F.col("gap_end") - F.col("gap_start") + 1 >= least * F.col("size"))).select(*by, "gap_start", "gap_end")


def tile_widths(tiles: DataFrame, by: list[str], share: str) -> DataFrame:
    """Display widths: shares under min(0.08, 1/n) get that floor, the others are scaled into the rest."""
    whole = Window.partitionBy(*by)
    floor = F.least(F.lit(0.08), 1.0 / F.count("*").over(whole))
    rows = tiles.withColumn("floor", floor).withColumn("is_small", F.col(share) < F.col("floor"))
    small, large = F.sum(F.when(F.col("is_small"), F.col("floor")).otherwise(0.0)).over(whole), F.sum(F.when(~F.col("is_small"), F.col(share)).otherwise(0.0)).over(whole)
    width = F.when(large == 0, 1.0 / F.count("*").over(whole)).when(F.col("is_small"), F.col("floor")).otherwise(F.col(share) * (1 - small) / large)
    return rows.withColumn("width", width).drop("floor", "is_small")


def enriched_partitions(partitions: DataFrame, kernel: DataFrame, identities: DataFrame, mounts: DataFrame, holders: DataFrame) -> DataFrame:
    """Partitions of a table with what the kernel, the identity scan, the mounts and the holders know of them.

    ``partitions``: device, number, start_lba. ``kernel``: device, start_lba, name, path, dev. ``identities``: path, fs_type,
    fs_uuid. ``mounts``: dev, source, mount_point. ``holders``: name, holder. A mount belongs by its device number or else by its source path:
    two equi-joins in union, as an OR would compare all with all. Unknown parts stay null, lists empty.
    """
    base = partitions.join(kernel, ["device", "start_lba"], "left").join(identities, "path", "left")
    by_dev = base.select("device", "number", "dev").join(mounts, "dev").select("device", "number", "mount_point")
    by_path = base.select("device", "number", F.col("path").alias("source")).join(mounts, "source").select("device", "number", "mount_point")
    mounted = by_dev.unionByName(by_path).distinct().groupBy("device", "number").agg(F.array_sort(F.collect_list("mount_point")).alias("mountpoints"))
    held = holders.distinct().groupBy("name").agg(F.array_sort(F.collect_list("holder")).alias("holders"))
    none = F.array().cast("array<string>")
    out = base.join(mounted, ["device", "number"], "left").join(held, "name", "left")
    return out.select("device", "number", "start_lba", "name", "path", "fs_type", "fs_uuid", F.coalesce("mountpoints", none).alias("mountpoints"), F.coalesce("holders", none).alias("holders"))


def is_offline(mountpoints: Column, holders: Column) -> Column:
    return (F.size(mountpoints) == 0) & (F.size(holders) == 0)
