"""Text of system tools as tables. Input: one row per line with file, line_no and line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import parse_ranges, trace_event


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, numbered within their file. One task reads one file, as order matters."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def key_values(lines: DataFrame, sep: str = "=") -> DataFrame:
    """``key = value`` lines: file, key, value; a later line of the same key counts."""
    at = F.locate(sep, "line")
    rows = lines.where(at > 0).select("file", "line_no", F.trim(F.substring_index("line", sep, 1)).alias("key"), F.trim(F.expr(f"substring(line, locate('{sep}', line) + {len(sep)})")).alias("value"))
    return rows.groupBy("file", "key").agg(F.max_by("value", "line_no").alias("value"))


def ext4_facts(lines: DataFrame) -> DataFrame:
    """Block size, counts and first block of a dumpe2fs listing: lines in column 0 before any group."""
    pick = lambda k: F.max(F.regexp_extract("line", rf"^{k}: +(\d+)$", 1).try_cast("bigint"))
    return lines.groupBy("file").agg(pick("Block size").alias("block_size"), pick("Block count").alias("block_count"), pick("First block").alias("first_block"), pick("Free blocks").alias("free_blocks"))


def ext4_free(lines: DataFrame) -> DataFrame:
    """Free ranges of each group: file, group_no, start, end_incl. The group is the last one named before the line."""
    group = F.nullif(F.regexp_extract("line", r"^Group (\d+):", 1), F.lit(""))
    line = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = lines.withColumn("group_no", F.last(group, ignorenulls=True).over(line).try_cast("int"))
    free = held.where(F.col("line").rlike(r"^\s+Free blocks: ")).select("file", "group_no", F.explode(parse_ranges(F.regexp_extract("line", r"Free blocks: (.*)$", 1))).alias("r"))
    return free.select("file", "group_no", "r.start", "r.end_incl")


def xfs_free(lines: DataFrame) -> DataFrame:
    """Free extents: lines of exactly three integers; others (histogram, heads) are ignored."""
    p = F.split(F.trim("line"), r"\s+")
    ok = (F.size(p) == 3) & F.forall(p, lambda x: x.rlike(r"^\d+$"))
    return lines.where(ok).select("file", *[p[i].cast("bigint").alias(n) for i, n in enumerate(("ag_no", "ag_block", "n_blocks"))])


def mountinfo(lines: DataFrame) -> DataFrame:
    """Mounts: mount_id, dev, root, mount_point, fs_type, source; octal escapes undone, short lines ignored."""
    left, right = F.split(F.substring_index("line", " - ", 1), " "), F.split(F.element_at(F.split("line", " - ", 2), -1), " ")
    ok = F.col("line").contains(" - ") & (F.size(left) >= 6) & (F.size(right) >= 2)

    def undo(c):
        for code, ch in (("\\040", " "), ("\\011", "\t"), ("\\012", "\n"), ("\\134", "\\")):
            c = F.replace(c, F.lit(code), F.lit(ch))
        return c

    return lines.where(ok).select("file", left[0].try_cast("int").alias("mount_id"), left[2].alias("dev"), undo(left[3]).alias("root"), undo(left[4]).alias("mount_point"), right[0].alias("fs_type"), undo(right[1]).alias("source"))


def blkid(lines: DataFrame) -> DataFrame:
    """Blank-line separated KEY=VALUE records, as maps; a record needs DEVNAME."""
    line = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    block = lines.withColumn("record", F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(line)).where(F.col("line").contains("="))
    pair = F.struct(F.substring_index("line", "=", 1).alias("key"), F.expr("substring(line, locate('=', line) + 1)").alias("value"))
    maps = block.groupBy("file", "record", pair["key"].alias("key")).agg(F.max_by(pair["value"], "line_no").alias("value")).groupBy("file", "record").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("facts"))
    return maps.where(F.col("facts")["DEVNAME"].isNotNull())


def subvolumes(lines: DataFrame) -> DataFrame:
    """``ID n gen n top level n path p`` lines."""
    p = r"^ID (\d+) .*top level (\d+) path (.+)$"
    return lines.where(F.col("line").rlike(p)).select("file", *[F.regexp_extract("line", p, i).alias(n) for i, n in ((1, "subvol_id"), (2, "top_level"), (3, "path"))])


def findmnt(docs: DataFrame, depth: int = 8) -> DataFrame:
    """Mounts of a findmnt JSON document (column json), children included. A document with mounts below ``depth`` levels
    is an error, as leaving them out would go unseen."""
    kind = "struct<target:string,source:string,fstype:string,options:string>"
    for _ in range(depth):
        kind = f"struct<target:string,source:string,fstype:string,options:string,children:array<{kind}>>"
    level = docs.select("file", F.explode(F.from_json("json", f"filesystems array<{kind}>")["filesystems"]).alias("m"))
    out = None
    for k in range(depth + 1):
        rows = level.select("file", F.lit(k).alias("level"), "m.target", "m.source", "m.fstype", "m.options")
        out = rows if out is None else out.unionByName(rows)
        if k < depth:
            level = level.select("file", F.explode("m.children").alias("m"))
    return out


def trace(lines: DataFrame) -> DataFrame:
    """Events of kernel trace lines; other lines are ignored, malformed ones are kept and marked."""
    return lines.select("file", "line_no", trace_event(F.col("line")).alias("e")).where("e is not null").select("file", "line_no", "e.*")


def loss_stats(lines: DataFrame) -> DataFrame:
    """Lost events per file, summed over the processors' statistics."""
    p = r"^(overrun|dropped events|commit overrun): (\d+)$"
    return lines.groupBy("file").agg(F.coalesce(F.sum(F.regexp_extract(F.trim("line"), p, 2).try_cast("bigint")), F.lit(0)).alias("n_lost"))


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Receipts, each a JSON file; one bad file fails the whole read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def cached_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A cached document, null where it can't be read."""
    return df.withColumn("parsed", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
