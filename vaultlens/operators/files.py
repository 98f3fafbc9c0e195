"""File trees: hard links, parents, order, increments, dedup, references, content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGULAR, DIRECTORY, SYMLINK, HARDLINK, SPECIAL = 1, 2, 3, 4, 5
# The fields whose equality makes a file unchanged.
COMPARED = ["file_kind", "mode", "uid", "gid", "mtime_sec", "mtime_nsec", "size", "rdev", "hardlink_group", "link_target", "xattrs"]


def parent_of(path: Column) -> Column:
    """Path up to the last slash; the empty path is the root."""
    text = F.decode(path, "UTF-8")
    cut = F.length(text) - F.locate("/", F.reverse(text))
    return F.when(F.locate("/", text) == 0, F.encode(F.lit(""), "UTF-8")).otherwise(F.encode(text.substr(F.lit(1), cut.cast("int")), "UTF-8"))


def depth_of(path: Column) -> Column:
    text = F.decode(path, "UTF-8")
    return F.length(text) - F.length(F.replace(text, F.lit("/"), F.lit("")))


def orphan_paths(entries: DataFrame, by: list[str]) -> DataFrame:
    """Entries whose parent path isn't a directory of the same listing (the root always is one)."""
    dirs = entries.where(F.col("file_kind") == DIRECTORY).select(*by, F.col("path").alias("parent_path"))
    return entries.where(F.length("parent_path") > 0).join(dirs, [*by, "parent_path"], "left_anti")


def hardlink_targets(entries: DataFrame, by: list[str]) -> DataFrame:
    """Each hard link with the first regular path of its group; target null where there is none."""
    group = [*by, "hardlink_group"]
    first = entries.where((F.col("file_kind") == REGULAR) & (F.col("hardlink_group") > 0)).groupBy(*group).agg(F.min("path").alias("target"))
    return entries.where((F.col("file_kind") == HARDLINK) & (F.col("hardlink_group") > 0)).select(*group, "path").join(first, group, "left")


def link_counts(entries: DataFrame, by: list[str]) -> DataFrame:
    """Names per hard-link group."""
    return entries.where(F.col("hardlink_group") > 0).groupBy(*by, "hardlink_group").agg(F.count("*").alias("n_links"))


def group_links(files: DataFrame, by: list[str], identity: list[str], order: str) -> DataFrame:
    """In walk order the first name of an inode keeps the content, the later ones become hard links; groups are
    numbered by their first name. Columns: is_first, link_group."""
    own = Window.partitionBy(*by, *identity)
    first = F.min(order).over(own)
    return files.withColumn("is_first", F.col(order) == first).withColumn("link_group", F.dense_rank().over(Window.partitionBy(*by).orderBy(first)))


def incremental(now: DataFrame, reference: DataFrame, key: list[str], by: list[str], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Entries against the reference listing: ``new``, ``unchanged`` (all compared fields equal) or ``changed``."""
    old = reference.select(*by, *key, *[F.col(c).alias(f"old_{c}") for c in COMPARED], F.lit(True).alias("known"))
    same = F.lit(True)
    for c in COMPARED:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return now.join(old, [*by, *key], "left").withColumn("status", F.when(F.col("known").isNull(), "new").when(same, "unchanged").otherwise("changed")).select(*by, *keep, *key, "file_kind", "size", "status")


def restore_order(entries: DataFrame, by: list[str]) -> DataFrame:
    """Position in which a tree is restored: directories, files, specials and symlinks, hard links; then by path bytes."""
    rank = F.when(F.col("file_kind") == DIRECTORY, 0).when(F.col("file_kind") == REGULAR, 1).when(F.col("file_kind") == HARDLINK, 3).otherwise(2)
    return entries.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(rank, "path")))


def deepest_first(entries: DataFrame, by: list[str]) -> DataFrame:
    """Position from the deepest path to the root, for metadata that children would disturb."""
    return entries.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(depth_of(F.col("path"))), F.desc("path"))))


def directory_page(entries: DataFrame, by: list[str], offset: int, limit: int) -> DataFrame:
    """A page of every directory: ``.``, ``..``, then children by name."""
    kids = entries.where(F.length("path") > 0).select(*by, F.col("parent_path").alias("dir"), F.lit(2).alias("rank"), F.col("path").alias("name"))
    dirs = kids.select(*by, "dir").distinct()
    dots = dirs.select(*by, "dir", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.lit(".").cast("binary").alias("name")), F.struct(F.lit(1).alias("rank"), F.lit("..").cast("binary").alias("name")))).alias("d")).select(*by, "dir", "d.rank", "d.name")
    at = F.row_number().over(Window.partitionBy(*by, "dir").orderBy("rank", "name")) - 1
    return kids.unionByName(dots).withColumn("place", at).where((F.col("place") >= offset) & (F.col("place") < offset + limit))


def first_occurrence(chunks: DataFrame, by: list[str], content: list[str], order: list[str]) -> DataFrame:
    """Marks the first chunk of each content; the others repeat it. The smallest order per content is
    aggregated before the shuffle and joined back, so a content with many copies stays spread."""
    first = chunks.groupBy(*by, *content).agg(F.min(F.struct(*order)).alias("first"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in [*by, *content]]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return chunks.alias("c").join(first.alias("f"), cond).select("c.*", (F.struct(*[F.col(f"c.{o}") for o in order]) == F.col("f.first")).alias("is_first"))


def dedup_summary(chunks: DataFrame, by: list[str], content: list[str], size: str) -> DataFrame:
    """Logical and unique bytes per group, without comparing rows with each other."""
    each = chunks.groupBy(*by, *content).agg(F.count("*").alias("n"), F.sum(size).alias("b"), F.max(size).alias("u"))
    return each.groupBy(*by).agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_unique"), F.sum("b").alias("logical_bytes"), F.sum("u").alias("unique_bytes"))


def owners(index: DataFrame, key: list[str], member: str, value: list[str]) -> DataFrame:
    """For each hash the entry of the last member that holds it."""
    return index.groupBy(*key).agg(F.max(F.struct(member, *value)).alias("o")).select(*key, "o.*")


def dangling(refs: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """References that no member's index holds."""
    return refs.join(index.select(*key).distinct(), key, "left_anti")


def running_offsets(chunks: DataFrame, by: list[str], order: list[str], size: str) -> DataFrame:
    """Where each chunk begins: the sum of the lengths before it."""
    line = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("file_offset", F.coalesce(F.sum(size).over(line), F.lit(0)))


def kind_counts(entries: DataFrame, by: list[str]) -> DataFrame:
    names = {REGULAR: "n_regular", DIRECTORY: "n_directory", SYMLINK: "n_symlink", HARDLINK: "n_hardlink", SPECIAL: "n_special"}
    return entries.groupBy(*by).agg(*[F.count(F.when(F.col("file_kind") == k, 1)).alias(n) for k, n in names.items()], F.sum(F.when(F.col("file_kind") == REGULAR, F.col("size"))).alias("bytes"))


def loss_summary(losses: DataFrame, what: str, examples: int = 3) -> DataFrame:
    """Losses by the first word of their text, with the first examples in order of the text.

    The examples are a bounded aggregate: each is found by a rank within its kind, after a first cut per hash bucket."""
    word = F.split(F.col(what), " ")[0]
    rows = losses.where(F.col(what).isNotNull()).groupBy(word.alias("kind"), F.col(what).alias("what")).agg(F.count("*").alias("n"))
    bucket = F.pmod(F.xxhash64("what"), F.lit(64))
    near = rows.withColumn("r", F.row_number().over(Window.partitionBy("kind", bucket).orderBy("what"))).where(F.col("r") <= examples)
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("what"))).where(F.col("r") <= examples).groupBy("kind").agg(F.sort_array(F.collect_list("what")).alias("examples"))
    return rows.groupBy("kind").agg(F.sum("n").alias("n_losses")).join(top, "kind")
