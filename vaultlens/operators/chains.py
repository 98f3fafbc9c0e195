"""Versioned chains: newest-wins state, differences, catalog, links, ancestry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Chunk states.
UNUSED, STORED, ZERO, BAD = 0, 1, 2, 3
STATE_BITS, MEMBER_MASK = 14, 0x3FFF


def newest_state(entries: DataFrame, key: list[str], seq: str, payload: list[str], upto: Column | None = None) -> DataFrame:
    """For each key the entry of the last member that mentions it (at or before ``upto``).

    One pre-aggregated shuffle; of entries with the same seq the larger payload wins.
    """
    rows = entries if upto is None else entries.where(F.col(seq) <= upto)
    return rows.groupBy(*key).agg(F.max(F.struct(seq, *payload)).alias("e")).select(*key, "e.*")


def is_change(old_state: Column, old_hash: Column, new_state: Column, new_hash: Column) -> Column:
    """Unchanged are stored chunks of equal hash, zero after zero, unused after unused; a bad one always is a change."""
    same = ((old_state == STORED) & (new_state == STORED) & old_hash.eqNullSafe(new_hash)) | ((old_state == new_state) & new_state.isin(ZERO, UNUSED))
    return ~F.coalesce(same, F.lit(False))


def scan_diff(parent: DataFrame, scan: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join of a parent's state (key, state, hash) and planned chunks (key, state, hash).

    Outcome: ``inherited`` (unplanned and unused before, or no change), ``unused`` (no longer planned), else
    ``stored``, ``zero`` or ``bad``.
    """
    p = parent.select(*key, F.col("state").alias("old_state"), F.col("hash").alias("old_hash"))
    s = scan.select(*key, F.col("state").alias("new_state"), F.col("hash").alias("new_hash"))
    both = p.join(s, key, "full_outer")
    old = F.coalesce("old_state", F.lit(UNUSED))
    changed = is_change(old, F.col("old_hash"), F.col("new_state"), F.col("new_hash"))
    outcome = F.when(F.col("new_state").isNull(), F.when(old == UNUSED, "inherited").otherwise("unused")).when(~changed, "inherited").when(F.col("new_state") == STORED, "stored").when(F.col("new_state") == ZERO, "zero").when(F.col("new_state") == BAD, "bad").otherwise("unused")
    return both.select(*key, "old_state", "new_state", outcome.alias("outcome"))


def parent_states(own: DataFrame, by: list[str], key: list[str], seq: str, payload: list[str]) -> DataFrame:
    """For every member present (``by``, ``seq``) but the first the merged state of all members before it: the newest
    earlier entry of each key. ``own`` holds one row per member and key. Members that never came leave no gap.

    The result is as large as all parent states together, which is what a full comparison has to read.
    """
    members = own.select(*by, seq).distinct()
    since = own.groupBy(*by, *key).agg(F.min(seq).alias("since"))
    cells = since.join(members, by).where(F.col(seq) > F.col("since")).select(*by, seq, *key)
    line = Window.partitionBy(*by, *key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    held = own.select(*by, seq, *key, F.struct(*payload).alias("e"), F.lit(False).alias("asked")).unionByName(cells.select(*by, seq, *key, F.lit(None).cast(own.select(F.struct(*payload).alias("e")).schema["e"].dataType).alias("e"), F.lit(True).alias("asked")))
    # an asked row and the member's own entry share a seq: the asked one comes first, so that it sees earlier members only
    line = line.orderBy(seq, F.desc("asked"))
    return held.withColumn("e", F.when(F.col("asked"), F.last("e", ignorenulls=True).over(line))).where("asked").select(*by, seq, *key, "e.*")


def upsert(parent: DataFrame, delta: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """The parent's rows with the delta's in place of those of equal key, and the delta's new ones."""
    rows = parent.select(*key, F.lit(0).alias("pri"), *payload).unionByName(delta.select(*key, F.lit(1).alias("pri"), *payload))
    return newest_state(rows, key, "pri", payload).withColumnRenamed("pri", "from_delta")


def pack_state(state: Column, member: Column) -> Column:
    return F.shiftleft(state.cast("int"), STATE_BITS).bitwiseOR(member.cast("int").bitwiseAND(MEMBER_MASK))


def unpack_state(packed: Column) -> tuple[Column, Column]:
    return F.shiftright(packed, STATE_BITS), packed.bitwiseAND(MEMBER_MASK)


def state_summary(state: DataFrame, by: list[str], offset: Column, n_chunks: Column) -> DataFrame:
    """Chunks by state and the first bad offset. What no entry mentions is unused: it is counted, not listed."""
    count = lambda s: F.count(F.when(F.col("state") == s, 1))
    unused = n_chunks - F.count(F.when(F.col("state") != UNUSED, 1))
    return state.groupBy(*by).agg(count(STORED).alias("n_stored"), count(ZERO).alias("n_zero"), unused.alias("n_unused"), count(BAD).alias("n_bad"), F.min(F.when(F.col("state") == BAD, offset)).alias("first_bad_offset"))


def member_role(seq: Column, image_kind: Column, is_delta: Column) -> Column:
    return F.when(seq == 0, "full").when((image_kind == "stream") | is_delta, "incremental").otherwise("differential")


def newest_scan(members: DataFrame, key: list[str], at: str, values: list[str]) -> DataFrame:
    """One row per member: that of its latest scan (ties: the largest values)."""
    return members.groupBy(*key).agg(F.max(F.struct(at, *values)).alias("m")).select(*key, "m.*")


def catalog(members: DataFrame) -> DataFrame:
    """One row per chain with its members in order of seq."""
    each = F.struct("seq_in_chain", "image_uuid", "member_kind", "size_bytes")
    return members.groupBy("chain_id").agg(F.min("set_id").alias("set_id"), F.min("created_unix").alias("created_unix"), F.count("*").alias("n_members"), F.sum("size_bytes").alias("size_bytes"), F.max("seq_in_chain").alias("latest_seq"), F.count(F.when(F.col("seq_in_chain") > 0, 1)).alias("n_incremental"), F.sort_array(F.collect_list(each)).alias("members"))


def completeness(members: DataFrame) -> DataFrame:
    """Whether a chain's seqs are 0..n-1, each once, with a full member at 0; and whether all members were verified."""
    ok = (F.min("seq_in_chain") == 0) & (F.max("seq_in_chain") + 1 == F.count("*")) & (F.countDistinct("seq_in_chain") == F.count("*")) & (F.count(F.when((F.col("seq_in_chain") == 0) & (F.col("member_kind") == "full"), 1)) == 1)
    return members.groupBy("chain_id").agg(F.coalesce(ok, F.lit(False)).alias("is_complete"), (F.count("verified_unix") == F.count("*")).alias("is_verified"), F.min("created_unix").alias("created_unix"), F.sum("size_bytes").alias("size_bytes"))


def link_warnings(members: DataFrame) -> DataFrame:
    """Members whose seq repeats or whose parent isn't the member before: chain_id, seq_in_chain, image_uuid, check_id."""
    line = Window.partitionBy("chain_id").orderBy("seq_in_chain", "image_uuid")
    prev, seq = F.lag("image_uuid").over(line), F.lag("seq_in_chain").over(line)
    bad = F.when(F.col("seq_in_chain") == seq, "duplicate_seq").when(F.col("seq_in_chain").isNotNull() & prev.isNotNull() & ~F.col("parent_uuid").eqNullSafe(prev), "broken_link").when(prev.isNull() & F.col("parent_uuid").isNotNull(), "parent_before_first")
    return members.select("chain_id", "seq_in_chain", "image_uuid", bad.alias("check_id")).where(F.col("check_id").isNotNull())


def chain_violations(members: DataFrame) -> DataFrame:
    """Members that do not fit their chain: position, chunk size, source size, kind or set."""
    line = Window.partitionBy("chain_id").orderBy("seq_in_chain", "image_uuid")
    first = lambda c: F.first(c).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    checks = [("position", F.col("seq_in_chain") != F.row_number().over(line) - 1)] + [(c, ~F.col(c).eqNullSafe(first(c))) for c in ("chunk_size", "image_kind", "set_id", "is_whole_disk")]
    each = members.select("chain_id", "seq_in_chain", "image_uuid", F.array(*[F.when(F.coalesce(test, F.lit(True)), name) for name, test in checks]).alias("c"))
    return each.select("chain_id", "seq_in_chain", "image_uuid", F.explode("c").alias("check_id")).where(F.col("check_id").isNotNull())


def latest_members(members: DataFrame) -> DataFrame:
    """The member of largest seq of each chain; of equal ones the largest uuid, told as ambiguous."""
    top = members.groupBy("chain_id").agg(F.max(F.struct("seq_in_chain", "image_uuid")).alias("m"), F.max("seq_in_chain").alias("s"))
    ties = members.groupBy("chain_id", F.col("seq_in_chain").alias("s")).agg((F.count("*") > 1).alias("is_ambiguous"))
    return top.join(ties, ["chain_id", "s"]).select("chain_id", "m.seq_in_chain", "m.image_uuid", "is_ambiguous")


def newest_chain(complete: DataFrame) -> DataFrame:
    """Per set the newest complete chain; ambiguous if two newest share a second."""
    line = Window.partitionBy("set_id").orderBy(F.desc("created_unix"))
    top = complete.where("is_complete").withColumn("r", F.rank().over(line)).where("r = 1")
    return top.groupBy("set_id").agg(F.max("chain_id").alias("chain_id"), F.max("created_unix").alias("created_unix"), (F.count("*") > 1).alias("is_ambiguous"))


def ancestry(members: DataFrame) -> DataFrame:
    """Per member the members of its chain with seq at or below its own, and whether one is missing."""
    line = Window.partitionBy("chain_id").orderBy("seq_in_chain")
    upto = line.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # distinct seqs so far; null ones come first and share the first rank
    distinct = F.dense_rank().over(line) - F.max(F.when(F.col("seq_in_chain").isNull(), 1).otherwise(0)).over(Window.partitionBy("chain_id"))
    return members.select("chain_id", "seq_in_chain", "image_uuid", F.count("*").over(upto).alias("n_ancestry"), F.sum("size_bytes").over(upto).alias("ancestry_bytes"), (distinct != F.col("seq_in_chain") + 1).alias("has_gap"))


def catalog_difference(a: DataFrame, b: DataFrame, compared: list[str]) -> DataFrame:
    """Rows that only one of two catalogs holds, on the compared columns; repeats count."""
    left, right = a.select(*compared), b.select(*compared)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def carry_verification(now: DataFrame, cached: DataFrame) -> DataFrame:
    """Verification times of cached members whose file name and size are as before."""
    old = cached.where("verified_unix is not null").groupBy("image_uuid", "file_name", "size_bytes").agg(F.max("verified_unix").alias("carried_unix"))
    return now.join(old, ["image_uuid", "file_name", "size_bytes"], "left")


def rollover(chains: DataFrame, limit: int) -> DataFrame:
    """Whether the next member starts a new chain, because the chain has reached the limit."""
    return chains.withColumn("starts_new", F.col("n_members") >= limit)


def misfits(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Members whose chunk size, whole-disk flag or kind differs from the parent's."""
    p = parents.select(F.col("image_uuid").alias("parent_uuid"), *[F.col(c).alias(f"p_{c}") for c in ("chunk_size", "is_whole_disk", "image_kind")])
    bad = F.concat_ws(",", *[F.when(~F.col(c).eqNullSafe(F.col(f"p_{c}")), c) for c in ("chunk_size", "is_whole_disk", "image_kind")])
    return children.join(p, "parent_uuid").select("image_uuid", bad.alias("differs")).where("differs <> ''")


def weakest(df: DataFrame, by: list[str], level: str) -> DataFrame:
    """The weakest consistency level of each group."""
    rank = consistency_rank(F.col(level))
    return df.where(rank.isNotNull()).groupBy(*by).agg(F.min_by(level, rank).alias("weakest"))


def consistency_rank(level: Column) -> Column:
    # Consistency levels by strength.
    ranks = {"point_in_time": 4, "frozen": 3, "offline": 2, "per_file": 1, "none": 0}
    table = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return table[level]
