"""Integrity: record layout, hashes, coverage and receipts. Violations are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layout_breaks(records: DataFrame, by: list[str], offset: str, length: str) -> DataFrame:
    """Records that begin before the one before ends (``overlap``) or later than it ends (``gap``)."""
    line = Window.partitionBy(*by).orderBy(offset, length)
    end = F.max(F.col(offset) + F.col(length)).over(line.rowsBetween(Window.unboundedPreceding, -1))
    bad = F.when(F.col(offset) < end, "overlap").when(F.col(offset) > end, "gap")
    return records.select(*by, offset, length, bad.alias("check_id")).where("check_id is not null")


def hash_report(records: DataFrame, by: list[str], stored: str, actual: Column) -> DataFrame:
    """Records by how their stored hash compares with their content: missing, stale, other case, equal."""
    s = F.col(stored)
    kind = F.when(s.isNull(), "missing").when(actual.isNull(), "no_content").when(s == actual, "equal").when(F.lower(s) == actual, "other_case").otherwise("stale")
    return records.groupBy(*by, kind.alias("verdict")).agg(F.count("*").alias("n_records"))


def repeated_nonces(records: DataFrame, by: list[str], nonce: str) -> DataFrame:
    """Nonces used for more than one content: those may never repeat. A record sent again isn't a repeat."""
    return records.where(F.col(nonce).isNotNull()).groupBy(*by, nonce).agg(F.countDistinct("content").alias("n_contents")).where("n_contents > 1").groupBy(*by).agg(F.count("*").alias("n_repeated"))


def length_breaks(records: DataFrame, payload: str, planned: str) -> DataFrame:
    """Records shorter than planned or longer."""
    n = F.length(payload)
    return records.withColumn("check_id", F.when(n < F.col(planned), "short").when(n > F.col(planned), "long")).where("check_id is not null")


def coverage_label(kind: Column, whole_disk: Column, every_member: Column) -> Column:
    """What a verification covered, by image kind, whole-disk flag and whether every member was read."""
    base = F.when(whole_disk, "whole_disk").when(kind == "block", "block").when(kind == "stream", "stream").otherwise("file")
    return F.concat(base, F.when((kind == "file") & ~whole_disk, "_chain").when(every_member, "_every_member").otherwise("_merged"))


def ordered_fingerprint(members: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One fingerprint of the ordered member list of each group, to match receipts by; n_members beside it."""
    each = F.struct(*order, *[v for v in values if v not in order])
    rows = F.sort_array(F.collect_list(each))
    return members.groupBy(*by).agg(F.sha2(F.to_json(F.transform(rows, lambda x: F.struct(*[x[v].alias(v) for v in values]))), 256).alias("fingerprint"), F.count("*").alias("n_members"))


def matching(a: DataFrame, b: DataFrame, by_a: str, by_b: str) -> DataFrame:
    """Pairs of groups whose ordered lists are equal and not empty, by fingerprint."""
    return a.join(b, "fingerprint").select(by_a, by_b)


def quota_usage(entries: DataFrame, by: list[str], size: str, most_entries: int, most_bytes: int) -> DataFrame:
    """Entries and bytes per group against two quotas."""
    return entries.groupBy(*by).agg(F.count("*").alias("n_entries"), F.sum(size).alias("n_bytes")).withColumn("is_over", (F.col("n_entries") > most_entries) | (F.coalesce("n_bytes", F.lit(0)) > most_bytes))


def payload_verdicts(entries: DataFrame, records: DataFrame, on: list[str], version: list[str], stored: str, payload: str, length: str) -> DataFrame:
    """Entries with what reading their payload tells: ``missing`` (no record), ``no_content``, ``short``, ``no_hash``, ``stale``
    (the content hashes to something else) or ``equal``.

    Of several records of one place the one with the largest ``version`` counts. The payload is hashed before the shuffle, so
    that only the verdict moves.
    """
    n, h = F.length(payload), F.col(stored)
    verdict = F.when(F.col(payload).isNull(), "no_content").when(n < F.col(length), "short").when(h.isNull(), "no_hash").when(F.lower(h) == F.sha2(payload, 256), "equal").otherwise("stale")
    judged = records.select(*on, F.struct(*version).alias("v"), verdict.alias("verdict"), n.alias("n_bytes")).groupBy(*on).agg(F.max(F.struct("v", "verdict", "n_bytes")).alias("r"))
    return entries.join(judged, on, "left").withColumn("verdict", F.coalesce("r.verdict", F.lit("missing"))).withColumn("n_bytes", F.coalesce("r.n_bytes", F.lit(0))).drop("r")


def restore_members(state: DataFrame, by: list[str], seq: str, length: str, stored: Column) -> DataFrame:
    """Members whose payloads a restore of the merged state reads, with chunks and bytes."""
    return state.where(stored).groupBy(*by, seq).agg(F.count("*").alias("n_chunks"), F.sum(length).alias("n_bytes"))


def order_breaks(regions: DataFrame, by: list[str], region: str, start: str, end: str) -> DataFrame:
    """Regions that begin before an earlier region of the same layout ends: by, region, start, reach."""
    line = Window.partitionBy(*by).orderBy(region).rowsBetween(Window.unboundedPreceding, -1)
    return regions.select(*by, region, start, F.max(end).over(line).alias("reach")).where(F.col(start) <= F.col("reach"))


def hash_index(records: DataFrame, by: list[str], hash_: str) -> DataFrame:
    """The distinct hashes of each group in order, with their position and the number of records."""
    each = records.where(F.col(hash_).isNotNull()).groupBy(*by, F.lower(hash_).alias("hash")).agg(F.count("*").alias("n_records"))
    return each.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("hash")) - 1)
