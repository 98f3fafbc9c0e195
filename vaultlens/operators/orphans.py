"""References to records that do not exist, arrive later or were deleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import hash_pair
from ..plans.sizing import shuffle_partitions
from ..session import cut

WEEK = 604_800
FAR = (1 << 63) - 1


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key range: parent rows come first, then batches of references.

    The parents become sorted arrays, the references are looked up by binary search on
    the first hash; the second hash and the table's hash decide among equal ones.
    """
    held: list[pa.RecordBatch] = []
    table = None
    for batch in batches:
        is_ref = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        if not is_ref.all():
            held.append(batch.slice(0, int((~is_ref).sum())))
            batch = batch.slice(int((~is_ref).sum()))
        if not batch.num_rows:
            continue
        if table is None:
            if held:
                t = pa.Table.from_batches(held)
                p1, p2, pa_, pd = (t.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in ("k1", "k2", "arrival", "retired"))
                order = np.lexsort((p2, p1))
                table = tuple(x[order] for x in (p1, p2, pa_, pd))
            else:
                table = (np.empty(0, np.int64),) * 4
            held = []
        p1, p2, arrives, retires = table
        k1, k2 = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("k1", "k2"))
        at = np.searchsorted(p1, k1)
        found = np.zeros(len(k1), bool)
        spot = at.copy()
        open_ = np.arange(len(k1))
        while len(open_):  # more than one turn only where two first hashes collide
            inside = spot[open_] < len(p1)
            open_ = open_[inside]
            hit = p1[spot[open_]] == k1[open_]
            open_ = open_[hit]
            good = p2[spot[open_]] == k2[open_]
            found[open_[good]] = True
            open_ = open_[~good]
            spot[open_] += 1
        at = np.minimum(spot, max(len(p1) - 1, 0))
        arrival = batch.column("arrival").to_numpy(zero_copy_only=False)
        if len(p1):
            late = found & (arrives[at] != FAR) & (arrival != FAR) & (arrives[at] > arrival)
            dead = found & (retires[at] != FAR) & (arrival != FAR) & (retires[at] <= arrival)
        else:
            late = dead = np.zeros(len(k1), bool)
        code = np.select([~found, late, dead], [1, 2, 3], 0).astype(np.int8)
        keep = np.flatnonzero(code)
        if len(keep):
            out = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([out.column("ref_table"), out.column("ref_key"), pa.array(code[keep]), out.column("arrival")], names=["ref_table", "ref_key", "code", "arrival"])


def orphan_references(refs: DataFrame, parents: DataFrame, hot_rows: int = 50_000, salts: int = 32) -> DataFrame:
    """Orphan references with their reason.

    ``refs``: ref_table, ref_key (names the referring record, unique per table),
    target (any type, the key referred to; null or none must be left out before),
    arrival bigint. ``parents``: ref_table, target, arrival, retired bigint (null: not
    retired); repeated parents count once with their smallest times. Reason, the first
    that holds: ``missing`` (no such parent), ``late`` (parent arrives after the
    reference), ``deleted`` (parent retired at or before the reference arrives). An
    unknown time is neither late nor deleted. No references give no rows, no parents
    make all missing.

    Result: ref_table, ref_key, reason, period_week (null for an unknown arrival).

    Keys are spread by the range of a 64-bit hash, one range a task; a task holds the
    sorted parents of its range only. References to a target named by more than
    ``hot_rows`` of them (and by more than 1/2000 of all, so that there are under 2000
    such targets) are spread over ``salts`` ranges into which that parent is copied.
    """
    spark, n = refs.sparkSession, shuffle_partitions(refs)
    k1, k2 = hash_pair(F.col("ref_table"), F.col("target"))
    r = cut(refs.where(F.col("target").isNotNull()).select("ref_table", "ref_key", k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col("arrival"), F.lit(FAR)).alias("arrival")), "refs")
    p = parents.where(F.col("target").isNotNull()).groupBy(k1.alias("k1"), k2.alias("k2")).agg(F.coalesce(F.min("arrival"), F.lit(FAR)).alias("arrival"), F.coalesce(F.min("retired"), F.lit(FAR)).alias("retired"))
    limit = max(hot_rows, r.count() // 2000)
    hot = cut(r.groupBy("k1").count().where(F.col("count") > limit).select("k1"), "hot")
    spread = lambda c: F.shiftrightunsigned(c, 33).cast("bigint") * n / F.lit(1 << 31)
    zero = F.lit(0)
    if hot.isEmpty():
        r, p = r.withColumn("salt", zero), p.withColumn("salt", zero)
    else:  # under 2000 rows by construction
        flag = F.broadcast(hot.withColumn("hot", F.lit(True)))
        r = r.join(flag, "k1", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("ref_key"), F.lit(salts))).otherwise(0).cast("int")).drop("hot")
        p = p.join(flag, "k1", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(zero)))).drop("hot")
    place = F.pmod(F.floor(spread(F.col("k1"))).cast("int") + F.col("salt"), F.lit(n)).cast("int").alias("place")
    both = p.select(F.lit(False).alias("is_ref"), F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("string").alias("ref_key"), "k1", "k2", "arrival", "retired", place).unionByName(r.select(F.lit(True).alias("is_ref"), "ref_table", "ref_key", "k1", "k2", "arrival", F.lit(FAR).alias("retired"), place))
    placed = both.repartitionById(n, "place").sortWithinPartitions("is_ref").select("is_ref", "ref_table", "ref_key", "k1", "k2", "arrival", "retired")
    found = placed.mapInArrow(_probe, "ref_table string, ref_key string, code tinyint, arrival bigint")
    reason = F.when(F.col("code") == 1, "missing").when(F.col("code") == 2, "late").otherwise("deleted")
    week = F.when(F.col("arrival") != FAR, F.floor(F.col("arrival") / WEEK).cast("bigint"))
    return found.select("ref_table", "ref_key", reason.alias("reason"), week.alias("period_week"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Misses per table, week and reason."""
    return orphans.groupBy("ref_table", "period_week", "reason").agg(F.count("*").alias("n_refs"))
