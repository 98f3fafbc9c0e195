"""Queries over chains, states, the catalog and retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains as ch
from ..operators import retention as rt
from ..operators import verify as vf
from ..operators.ranges import index_gaps
from ..session import cut
from ..sources import table
from . import bind
from .bind import CHUNKS, ENTRIES, MEM, NEWEST, SCANS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {ENTRIES}, {NEWEST} SELECT chain_id, region, chunk_index, seq, plan_id, state FROM newest")
def merged_state(spark, d):
    return bind.newest(spark, d).select("chain_id", "region", "chunk_index", "seq", "plan_id", "state")


@query(f"WITH {ENTRIES}, e2 AS (SELECT * FROM entries WHERE seq <= 2), {NEWEST.replace('FROM entries', 'FROM e2')} SELECT chain_id, region, chunk_index, seq, plan_id, state FROM newest")
def state_at_recovery_point(spark, d):
    return ch.newest_state(bind.entries(spark, d), ["chain_id", "region", "chunk_index"], "seq", bind.PAYLOAD, upto=F.lit(2)).select("chain_id", "region", "chunk_index", "seq", "plan_id", "state")


@query(f"""WITH {ENTRIES}, {NEWEST} SELECT chain_id, region, count(*) FILTER (state = 1) AS n_stored, count(*) FILTER (state = 2) AS n_zero, max(chunk_index) + 1 - count(*) FILTER (state <> 0) AS n_unused, count(*) FILTER (state = 3) AS n_bad,
 min(CASE WHEN state = 3 THEN chunk_index * {bind.CHUNK} END) AS first_bad_offset FROM newest GROUP BY 1, 2""")
def block_summary(spark, d):
    return ch.state_summary(bind.newest(spark, d), ["chain_id", "region"], F.col("chunk_index") * bind.CHUNK, F.max("chunk_index") + 1)


@query(f"""WITH {ENTRIES}, {NEWEST}, g AS (SELECT chain_id, region, coalesce(lag(chunk_index) OVER (PARTITION BY chain_id, region ORDER BY chunk_index), -1) + 1 AS first_missing, chunk_index - 1 AS last_missing FROM newest) SELECT * FROM g WHERE first_missing <= last_missing""")
def gap_fill(spark, d):
    return index_gaps(bind.newest(spark, d), ["chain_id", "region"], "chunk_index")


@query(f"WITH {ENTRIES} SELECT chain_id, seq, count(*) AS n_own, sum(CASE WHEN state = 1 THEN plan_len ELSE 0 END) AS stored_bytes FROM entries GROUP BY 1, 2")
def own_payloads(spark, d):
    return bind.entries(spark, d).groupBy("chain_id", "seq").agg(F.count("*").alias("n_own"), F.sum(F.when(F.col("state") == ch.STORED, F.col("plan_len")).otherwise(0)).alias("stored_bytes"))


def _halves(spark, d):
    """Every member's own entries, and as its parent's state the merged entries of all members before it."""
    key = ["chain_id", "seq", "region", "chunk_index"]
    own = ch.newest_state(bind.entries(spark, d), key, "received_unix", ["plan_id", "state", "plan_offset"]).withColumn("hash", F.col("plan_offset").cast("string"))
    own = cut(own, "own")
    return ch.parent_states(own, ["chain_id"], ["region", "chunk_index"], "seq", ["plan_id", "state", "plan_offset", "hash"]), own, key


_HALVES = f"""WITH {ENTRIES}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, seq, region, chunk_index ORDER BY received_unix DESC, plan_id DESC) AS rn FROM entries) WHERE rn = 1),
cells AS (SELECT f.chain_id, s.seq, f.region, f.chunk_index FROM (SELECT chain_id, region, chunk_index, min(seq) AS since FROM n GROUP BY 1, 2, 3) f JOIN (SELECT DISTINCT chain_id, seq FROM n) s ON s.chain_id = f.chain_id AND s.seq > f.since),
o AS (SELECT c.chain_id, c.seq, c.region, c.chunk_index, n.plan_id, n.state, n.plan_offset FROM cells c ASOF JOIN n ON c.chain_id = n.chain_id AND c.region = n.region AND c.chunk_index = n.chunk_index AND c.seq > n.seq)"""
_DIFF = _HALVES + """, x AS (SELECT chain_id, seq, region, chunk_index, o.state AS old_state, n.state AS new_state, o.plan_offset AS oh, n.plan_offset AS nh FROM o FULL JOIN n USING (chain_id, seq, region, chunk_index)),
y AS (SELECT *, CASE WHEN new_state IS NULL THEN CASE WHEN coalesce(old_state, 0) = 0 THEN 'inherited' ELSE 'unused' END
  WHEN (coalesce(old_state, 0) = 1 AND new_state = 1 AND oh IS NOT DISTINCT FROM nh) OR (coalesce(old_state, 0) = new_state AND new_state IN (0, 2)) THEN 'inherited'
  WHEN new_state = 1 THEN 'stored' WHEN new_state = 2 THEN 'zero' WHEN new_state = 3 THEN 'bad' ELSE 'unused' END AS outcome FROM x)"""


@query(_DIFF + " SELECT chain_id, seq, region, chunk_index, old_state, new_state, outcome FROM y")
def scan_diff(spark, d):
    return ch.scan_diff(*_halves(spark, d))


@query(_DIFF + " SELECT chain_id, seq, outcome, count(*) AS n_chunks FROM y GROUP BY 1, 2, 3")
def backup_counts(spark, d):
    return ch.scan_diff(*_halves(spark, d)).groupBy("chain_id", "seq", "outcome").agg(F.count("*").alias("n_chunks"))


@query(_HALVES + " SELECT chain_id, seq, region, chunk_index, CAST(n.plan_id IS NOT NULL AS INTEGER) AS from_delta, coalesce(n.plan_id, o.plan_id) AS plan_id FROM o FULL JOIN n USING (chain_id, seq, region, chunk_index)")
def delta_upsert(spark, d):
    old, new, key = _halves(spark, d)
    return ch.upsert(old, new, key, ["plan_id"])


@query(f"WITH {ENTRIES} SELECT plan_id, (state << 14) | (seq & 16383) AS packed, state, seq & 16383 AS member FROM entries")
def pack_unpack_state(spark, d):
    packed = bind.entries(spark, d).select("plan_id", ch.pack_state(F.col("state"), F.col("seq")).alias("packed"))
    state, member = ch.unpack_state(F.col("packed"))
    return packed.select("plan_id", "packed", state.alias("state"), member.alias("member"))


@query(f"WITH {MEM} SELECT image_uuid, chain_id, set_id, seq_in_chain, member_kind, size_bytes, scanned_unix FROM mem")
def latest_scan(spark, d):
    return bind.members(spark, d).select("image_uuid", "chain_id", "set_id", "seq_in_chain", "member_kind", "size_bytes", "scanned_unix")


@query(f"WITH {MEM} SELECT image_uuid, member_kind, CASE WHEN seq_in_chain = 0 THEN 'full' WHEN image_kind = 'stream' OR is_delta THEN 'incremental' ELSE 'differential' END AS derived_kind FROM mem")
def member_roles(spark, d):
    return bind.members(spark, d).select("image_uuid", "member_kind", ch.member_role(F.col("seq_in_chain"), F.col("image_kind"), F.col("is_delta")).alias("derived_kind"))


@query(f"""WITH {MEM} SELECT chain_id, min(set_id) AS set_id, min(created_unix) AS created_unix, count(*) AS n_members, sum(size_bytes) AS size_bytes, max(seq_in_chain) AS latest_seq, count(*) FILTER (seq_in_chain > 0) AS n_incremental,
string_agg(image_uuid, ',' ORDER BY seq_in_chain NULLS FIRST, image_uuid) AS images FROM mem GROUP BY 1""")
def catalog_build(spark, d):
    c = ch.catalog(bind.members(spark, d))
    return c.select(*[x for x in c.columns if x != "members"], F.array_join(F.col("members.image_uuid"), ",").alias("images"))


@query(f"WITH {MEM} SELECT set_id, count(DISTINCT chain_id) AS n_chains, count(*) AS n_members, sum(size_bytes) AS size_bytes FROM mem GROUP BY 1")
def catalog_totals(spark, d):
    return ch.catalog(bind.members(spark, d)).groupBy("set_id").agg(F.count("*").alias("n_chains"), F.sum("n_members").alias("n_members"), F.sum("size_bytes").alias("size_bytes"))


_COMPLETE = f"""{MEM}, comp AS (SELECT chain_id, min(set_id) AS set_id, coalesce(min(seq_in_chain) = 0 AND max(seq_in_chain) + 1 = count(*) AND count(DISTINCT seq_in_chain) = count(*) AND count(*) FILTER (seq_in_chain = 0 AND member_kind = 'full') = 1, false) AS is_complete,
count(verified_unix) = count(*) AS is_verified, min(created_unix) AS created_unix, sum(size_bytes) AS size_bytes FROM mem GROUP BY 1)"""


@query(f"WITH {_COMPLETE} SELECT chain_id, is_complete, is_verified, created_unix, size_bytes FROM comp")
def chain_complete(spark, d):
    return ch.completeness(bind.members(spark, d))


@query(f"""WITH {MEM}, w AS (SELECT *, lag(image_uuid) OVER l AS prev, lag(seq_in_chain) OVER l AS ps FROM mem WINDOW l AS (PARTITION BY chain_id ORDER BY seq_in_chain NULLS FIRST, image_uuid)),
v AS (SELECT chain_id, seq_in_chain, image_uuid, CASE WHEN seq_in_chain = ps THEN 'duplicate_seq' WHEN seq_in_chain IS NOT NULL AND prev IS NOT NULL AND parent_uuid IS DISTINCT FROM prev THEN 'broken_link' WHEN prev IS NULL AND parent_uuid IS NOT NULL THEN 'parent_before_first' END AS check_id FROM w)
SELECT * FROM v WHERE check_id IS NOT NULL""")
def chain_link_warnings(spark, d):
    return ch.link_warnings(bind.members(spark, d))


@query(f"""WITH {MEM}, w AS (SELECT chain_id, seq_in_chain, image_uuid, seq_in_chain <> row_number() OVER l - 1 AS position, chunk_size IS DISTINCT FROM first_value(chunk_size) OVER l AS chunk_size, image_kind IS DISTINCT FROM first_value(image_kind) OVER l AS image_kind,
set_id IS DISTINCT FROM first_value(set_id) OVER l AS set_id, is_whole_disk IS DISTINCT FROM first_value(is_whole_disk) OVER l AS is_whole_disk FROM mem WINDOW l AS (PARTITION BY chain_id ORDER BY seq_in_chain NULLS FIRST, image_uuid))
SELECT chain_id, seq_in_chain, image_uuid, 'position' AS check_id FROM w WHERE coalesce(position, true) UNION ALL SELECT chain_id, seq_in_chain, image_uuid, 'chunk_size' FROM w WHERE chunk_size
UNION ALL SELECT chain_id, seq_in_chain, image_uuid, 'image_kind' FROM w WHERE image_kind UNION ALL SELECT chain_id, seq_in_chain, image_uuid, 'set_id' FROM w WHERE set_id UNION ALL SELECT chain_id, seq_in_chain, image_uuid, 'is_whole_disk' FROM w WHERE is_whole_disk""")
def chain_violations(spark, d):
    return ch.chain_violations(bind.members(spark, d))


@query(f"""WITH {MEM}, t AS (SELECT chain_id, max(seq_in_chain) AS s FROM mem GROUP BY 1)
SELECT t.chain_id, t.s AS seq_in_chain, max(image_uuid) AS image_uuid, count(*) > 1 AS is_ambiguous FROM t JOIN mem ON t.chain_id = mem.chain_id AND t.s = mem.seq_in_chain GROUP BY 1, 2""")
def latest_member(spark, d):
    return ch.latest_members(bind.members(spark, d))


@query(f"""WITH {_COMPLETE}, t AS (SELECT *, rank() OVER (PARTITION BY set_id ORDER BY created_unix DESC NULLS LAST) AS r FROM comp WHERE is_complete)
SELECT set_id, max(chain_id) AS chain_id, max(created_unix) AS created_unix, count(*) > 1 AS is_ambiguous FROM t WHERE r = 1 GROUP BY 1""")
def newest_chain(spark, d):
    return ch.newest_chain(_complete(spark, d))


@query(f"""WITH {MEM} SELECT chain_id, seq_in_chain, image_uuid, count(*) OVER l AS n_ancestry, sum(size_bytes) OVER l AS ancestry_bytes, len(list_distinct(array_agg(seq_in_chain) OVER l)) <> seq_in_chain + 1 AS has_gap
FROM mem WINDOW l AS (PARTITION BY chain_id ORDER BY seq_in_chain NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def ancestor_closure(spark, d):
    return ch.ancestry(bind.members(spark, d))


@query(f"""WITH {SCANS}, a AS (SELECT chain_id, image_uuid, seq_in_chain, size_bytes, file_name FROM scans WHERE scanned_unix < 1750000000), b AS (SELECT chain_id, image_uuid, seq_in_chain, size_bytes, file_name FROM scans WHERE scanned_unix >= 1750000000)
SELECT *, 'left' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'right' AS side FROM (FROM b EXCEPT ALL FROM a)""")
def catalog_diff(spark, d):
    s = bind.scans(spark, d)
    return ch.catalog_difference(s.where("scanned_unix < 1750000000"), s.where("scanned_unix >= 1750000000"), ["chain_id", "image_uuid", "seq_in_chain", "size_bytes", "file_name"])


@query(f"""WITH {MEM}, c AS (SELECT image_uuid, file_name, size_bytes, max(verified_unix) AS carried_unix FROM scans WHERE verified_unix IS NOT NULL GROUP BY 1, 2, 3)
SELECT mem.image_uuid, mem.verified_unix, carried_unix FROM mem LEFT JOIN c USING (image_uuid, file_name, size_bytes)""")
def carry_verification(spark, d):
    return ch.carry_verification(bind.members(spark, d), bind.scans(spark, d)).select("image_uuid", "verified_unix", "carried_unix")


@query(f"WITH {MEM} SELECT chain_id, count(*) AS n_members, count(*) >= 8 AS starts_new FROM mem GROUP BY 1")
def rollover(spark, d):
    return ch.rollover(ch.catalog(bind.members(spark, d)).select("chain_id", "n_members"), 8)


@query(f"""WITH {MEM}, j AS (SELECT c.image_uuid, concat_ws(',', CASE WHEN c.chunk_size IS DISTINCT FROM p.chunk_size THEN 'chunk_size' END, CASE WHEN c.is_whole_disk IS DISTINCT FROM p.is_whole_disk THEN 'is_whole_disk' END, CASE WHEN c.image_kind IS DISTINCT FROM p.image_kind THEN 'image_kind' END) AS differs
FROM mem c JOIN mem p ON c.parent_uuid = p.image_uuid) SELECT * FROM j WHERE differs <> ''""")
def parent_misfits(spark, d):
    m = bind.members(spark, d)
    return ch.misfits(m, m)


_RANK = "CASE consistency WHEN 'point_in_time' THEN 4 WHEN 'frozen' THEN 3 WHEN 'offline' THEN 2 WHEN 'per_file' THEN 1 WHEN 'none' THEN 0 END"


@query(f"WITH {MEM} SELECT chain_id, arg_min(consistency, {_RANK}) AS weakest FROM mem WHERE {_RANK} IS NOT NULL GROUP BY 1")
def weakest_consistency(spark, d):
    return ch.weakest(bind.members(spark, d), ["chain_id"], "consistency")


def _complete(spark, d):
    m = bind.members(spark, d)
    return ch.completeness(m).join(m.groupBy("chain_id").agg(F.min("set_id").alias("set_id")), "chain_id")


def _kept(spark, d):
    sets = table(spark, d, "backup_sets").select("set_id", "keep_chains")  # fixed table of 40 rows
    return _complete(spark, d).join(F.broadcast(sets), "set_id", "left")


_PLAN = f"""{_COMPLETE}, k AS (SELECT comp.*, greatest(coalesce(keep_chains, 1), 1) AS n, row_number() OVER (PARTITION BY comp.set_id ORDER BY is_complete DESC, comp.created_unix DESC NULLS LAST, chain_id DESC) AS rank FROM comp LEFT JOIN backup_sets b ON b.set_id = comp.set_id),
f AS (SELECT *, is_complete AND rank <= n AS kept FROM k), g AS (SELECT *, max(CAST(kept AND is_verified AS INTEGER)) OVER s AS safe, min(CASE WHEN is_complete AND is_verified AND rank > n THEN rank END) OVER s AS spare, max(CASE WHEN is_complete THEN created_unix END) OVER s AS newest FROM f WINDOW s AS (PARTITION BY set_id)),
h AS (SELECT set_id, chain_id, created_unix, size_bytes, CASE WHEN kept THEN 'keep' WHEN safe = 0 AND rank = spare THEN 'keep_verified' WHEN is_complete THEN 'delete' WHEN created_unix <= newest THEN 'delete_incomplete' ELSE 'keep_recent' END AS decision FROM g),
plan AS (SELECT set_id, chain_id, created_unix, decision, CASE WHEN decision LIKE 'delete%' THEN size_bytes ELSE 0 END AS freed_bytes, CASE WHEN decision LIKE 'delete%' THEN row_number() OVER (PARTITION BY set_id, decision LIKE 'delete%' ORDER BY created_unix NULLS FIRST, chain_id) END AS position FROM h)"""


@query(f"WITH {_PLAN} SELECT * FROM plan")
def retention_plan(spark, d):
    return rt.retention_plan(_kept(spark, d))


@query(f"WITH {_PLAN} SELECT set_id, count(*) FILTER (decision LIKE 'delete%') AS n_deleted, sum(freed_bytes) AS freed_bytes FROM plan GROUP BY 1")
def retention_freed(spark, d):
    return rt.freed(rt.retention_plan(_kept(spark, d)))


@query(f"""WITH {_COMPLETE}, v AS (SELECT set_id, chain_id, is_verified, coalesce(sum(CAST(is_verified AS INTEGER)) OVER (PARTITION BY set_id ORDER BY created_unix DESC NULLS LAST, chain_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed_before FROM comp WHERE is_complete)
SELECT set_id, chain_id, is_verified, passed_before FROM v WHERE passed_before < 2""")
def verify_until_n(spark, d):
    return rt.verify_until(_complete(spark, d), 2).select("set_id", "chain_id", "is_verified", "passed_before")


@query(f"""WITH {CHUNKS} SELECT chain_id, CASE WHEN hash IS NULL THEN 'missing' WHEN payload IS NULL THEN 'no_content' WHEN hash = sha256(payload) THEN 'equal' WHEN lower(hash) = sha256(payload) THEN 'other_case' ELSE 'stale' END AS verdict, count(*) AS n_records FROM ck GROUP BY 1, 2""")
def hash_report(spark, d):
    return vf.hash_report(bind.chunks(spark, d), ["chain_id"], "hash", F.sha2("payload", 256))


@query(f"""WITH {CHUNKS}, w AS (SELECT chain_id, member_seq, chunk_offset, plan_len, max(chunk_offset + plan_len) OVER (PARTITION BY chain_id, member_seq ORDER BY chunk_offset NULLS FIRST, plan_len NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e
FROM (SELECT chain_id, member_seq, chunk_offset, plain_len AS plan_len FROM ck)), v AS (SELECT chain_id, member_seq, chunk_offset, plan_len AS plain_len, CASE WHEN chunk_offset < e THEN 'overlap' WHEN chunk_offset > e THEN 'gap' END AS check_id FROM w) SELECT * FROM v WHERE check_id IS NOT NULL""")
def record_layout_breaks(spark, d):
    return vf.layout_breaks(bind.chunks(spark, d), ["chain_id", "member_seq"], "chunk_offset", "plain_len")


@query(f"WITH {CHUNKS}, n AS (SELECT chain_id, nonce, count(DISTINCT sha256(payload)) AS c FROM ck WHERE nonce IS NOT NULL GROUP BY 1, 2) SELECT chain_id, count(*) AS n_repeated FROM n WHERE c > 1 GROUP BY 1")
def repeated_nonces(spark, d):
    return vf.repeated_nonces(bind.chunks(spark, d).withColumn("content", F.sha2("payload", 256)), ["chain_id"], "nonce")


@query("SELECT chunk_id, CASE WHEN octet_length(payload) < plain_len THEN 'short' ELSE 'long' END AS check_id FROM chunks WHERE octet_length(payload) <> plain_len")
def length_breaks(spark, d):
    return vf.length_breaks(table(spark, d, "chunks"), "payload", "plain_len").select("chunk_id", "check_id")


@query(f"""WITH {MEM} SELECT image_uuid, CASE WHEN is_whole_disk THEN 'whole_disk' WHEN image_kind = 'block' THEN 'block' WHEN image_kind = 'stream' THEN 'stream' ELSE 'file' END || CASE WHEN image_kind = 'file' AND NOT is_whole_disk THEN '_chain' WHEN verified_unix IS NOT NULL THEN '_every_member' ELSE '_merged' END AS coverage
FROM mem WHERE image_kind IS NOT NULL AND is_whole_disk IS NOT NULL""")
def coverage_labels(spark, d):
    m = bind.members(spark, d).where("image_kind is not null and is_whole_disk is not null")
    return m.select("image_uuid", vf.coverage_label(F.col("image_kind"), F.col("is_whole_disk"), F.col("verified_unix").isNotNull()).alias("coverage"))


@query(f"""WITH {ENTRIES}, g AS (SELECT chain_id, seq, string_agg(CAST(region AS VARCHAR) || ':' || CAST(chunk_index AS VARCHAR), ',' ORDER BY region, chunk_index) AS l FROM (SELECT DISTINCT chain_id, seq, region, chunk_index FROM entries) GROUP BY 1, 2)
SELECT a.chain_id || '#' || a.seq AS a_name, b.chain_id || '#' || b.seq AS b_name FROM g a JOIN g b ON a.l = b.l WHERE a.chain_id || '#' || a.seq < b.chain_id || '#' || b.seq""")
def receipt_match(spark, d):
    lists = bind.entries(spark, d).select(F.concat_ws("#", "chain_id", "seq").alias("name"), "region", "chunk_index").distinct()
    prints = vf.ordered_fingerprint(lists, ["name"], ["region", "chunk_index"], ["region", "chunk_index"])
    return vf.matching(prints.select("fingerprint", F.col("name").alias("a_name")), prints.select("fingerprint", F.col("name").alias("b_name")), "a_name", "b_name").where("a_name < b_name")


@query("SELECT destination, count(*) AS n_entries, sum(keep_chains) AS n_bytes, count(*) > 1 OR sum(keep_chains) > 5 AS is_over FROM backup_sets GROUP BY 1")
def ledger_quota(spark, d):
    return vf.quota_usage(table(spark, d, "backup_sets"), ["destination"], "keep_chains", 1, 5)
