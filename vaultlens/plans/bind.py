"""The test tables as the operators' inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import canonical_id, id_hex, id_or_null
from ..operators import chains as ch
from ..sources import table
from .data_queries import _NONE, _canon, _hex

MEMBER = ["chain_id", "seq_in_chain", "parent_uuid", "member_kind", "image_kind", "consistency", "created_unix", "chunk_size", "is_delta", "is_whole_disk", "size_bytes", "file_name", "verified_unix", "set_id"]
CHUNK = 1 << 20


def scans(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "members")
    return m.withColumn("image_uuid", canonical_id("image_uuid")).withColumn("parent_uuid", id_or_null("parent_uuid")).withColumn("chain_id", canonical_id("chain_id")).withColumn("set_id", canonical_id("set_id"))


def members(spark: SparkSession, d: str) -> DataFrame:
    """One row per image: its latest scan."""
    return ch.newest_scan(scans(spark, d), ["image_uuid"], "scanned_unix", MEMBER)


SCANS = f"""scans AS (SELECT * REPLACE ({_canon('image_uuid')} AS image_uuid, nullif({_canon('parent_uuid')}, '{_NONE}') AS parent_uuid, {_canon('chain_id')} AS chain_id, {_canon('set_id')} AS set_id) FROM members)"""
MEM = SCANS + f""", mem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_uuid ORDER BY scanned_unix DESC NULLS LAST, {', '.join(f'{c} DESC NULLS LAST' for c in MEMBER)}) AS rn FROM scans) WHERE rn = 1)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Planned chunk reads as block entries: a short one is bad, one without length unused."""
    p = table(spark, d, "chunk_plan").where("chunk_index is not null")
    state = F.when(F.col("plan_len").isNull(), ch.UNUSED).when(F.col("plan_len") <= 0, ch.ZERO).when(F.col("plan_len") < CHUNK, ch.BAD).otherwise(ch.STORED)
    return p.select(canonical_id("chain_id").alias("chain_id"), "region", "chunk_index", "seq", "received_unix", "plan_id", "plan_offset", "plan_len", state.alias("state"))


STATE = f"CASE WHEN plan_len IS NULL THEN 0 WHEN plan_len <= 0 THEN 2 WHEN plan_len < {CHUNK} THEN 3 ELSE 1 END"
ENTRIES = f"entries AS (SELECT {_canon('chain_id')} AS chain_id, region, chunk_index, seq, received_unix, plan_id, plan_offset, plan_len, {STATE} AS state FROM chunk_plan WHERE chunk_index IS NOT NULL)"
PAYLOAD = ["received_unix", "plan_id", "state", "plan_offset", "plan_len"]
NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, region, chunk_index ORDER BY seq DESC, received_unix DESC, plan_id DESC) AS rn FROM entries) WHERE rn = 1)"


def newest(spark: SparkSession, d: str) -> DataFrame:
    return ch.newest_state(entries(spark, d), ["chain_id", "region", "chunk_index"], "seq", PAYLOAD)


ENTRY = ["entry_id", "parent_path", "file_kind", "mode", "uid", "gid", "mtime_sec", "mtime_nsec", "size", "rdev", "hardlink_group", "link_target"]


def listing(spark: SparkSession, d: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per record (chain, seq, path): that delivered last."""
    e = table(spark, d, "file_entries").withColumn("chain_key", F.unhex(id_hex("chain_id")))
    top = e.groupBy("chain_key", "seq", "path").agg(F.max(F.struct("delivered_unix", *ENTRY, *extra)).alias("e"))
    return top.select("chain_key", "seq", "path", "e.*")


LISTING = f"""listing AS (SELECT * FROM (SELECT * REPLACE ({_hex('chain_id')} AS chain_id), row_number() OVER (PARTITION BY {_hex('chain_id')}, seq, path
  ORDER BY delivered_unix DESC NULLS LAST, {', '.join(f'{c} DESC NULLS LAST' for c in ENTRY)}) AS rn FROM file_entries) WHERE rn = 1)"""
STEPS = "steps AS (SELECT chain_id, seq, lag(seq) OVER (PARTITION BY chain_id ORDER BY seq) AS prev_seq, min(seq) OVER (PARTITION BY chain_id) AS first_seq FROM (SELECT DISTINCT chain_id, seq FROM listing))"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").withColumn("chain_id", canonical_id("chain_id"))


CHUNKS = f"ck AS (SELECT * REPLACE ({_canon('chain_id')} AS chain_id) FROM chunks)"


def chain_text(c: str = "chain_key"):
    return F.lower(F.hex(c))
