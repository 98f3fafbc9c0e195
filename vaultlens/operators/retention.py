"""Which chains stay and which go."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retention_plan(chains: DataFrame, keep: str = "keep_chains") -> DataFrame:
    """Decision per chain: set_id, chain_id, decision, freed_bytes, position.

    ``chains``: set_id, chain_id, created_unix, size_bytes, is_complete, is_verified and the column ``keep``
    (null counts as 1). Complete chains are ranked from the newest (ties by chain_id); max(keep, 1) stay. If
    none of those is verified, the first verified one beyond stays too. Other complete chains go, and
    incomplete ones that are not newer than the newest complete one. position orders what goes from the oldest.
    """
    line = Window.partitionBy("set_id").orderBy(F.desc("is_complete"), F.desc("created_unix"), F.desc("chain_id"))
    whole = Window.partitionBy("set_id")
    n = F.greatest(F.coalesce(F.col(keep), F.lit(1)), F.lit(1))
    ranked = chains.withColumn("rank", F.row_number().over(line))
    kept = F.col("is_complete") & (F.col("rank") <= n)
    facts = ranked.withColumn("kept", kept).withColumn("safe", F.max((F.col("kept") & F.col("is_verified")).cast("int")).over(whole)).withColumn("spare", F.min(F.when(F.col("is_complete") & F.col("is_verified") & (F.col("rank") > n), F.col("rank"))).over(whole)).withColumn("newest", F.max(F.when(F.col("is_complete"), F.col("created_unix"))).over(whole))
    decision = F.when(F.col("kept"), "keep").when((F.col("safe") == 0) & (F.col("rank") == F.col("spare")), "keep_verified").when(F.col("is_complete"), "delete").when(F.col("created_unix") <= F.col("newest"), "delete_incomplete").otherwise("keep_recent")
    out = facts.select("set_id", "chain_id", "created_unix", decision.alias("decision"), F.when(decision.startswith("delete"), F.col("size_bytes")).otherwise(0).alias("freed_bytes"))
    return out.withColumn("position", F.when(F.col("decision").startswith("delete"), F.row_number().over(Window.partitionBy("set_id", F.col("decision").startswith("delete")).orderBy("created_unix", "chain_id"))))


def freed(plan: DataFrame) -> DataFrame:
    return plan.groupBy("set_id").agg(F.count(F.when(F.col("decision").startswith("delete"), 1)).alias("n_deleted"), F.sum("freed_bytes").alias("freed_bytes"))


def verify_until(chains: DataFrame, needed: int) -> DataFrame:
    """Chains to verify, newest first, until ``needed`` of a set passed: those with fewer passes before them."""
    line = Window.partitionBy("set_id").orderBy(F.desc("created_unix"), F.desc("chain_id")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("is_verified").cast("int")).over(line), F.lit(0))
    return chains.where("is_complete").withColumn("passed_before", before).where(F.col("passed_before") < needed)
