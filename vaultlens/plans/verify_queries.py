"""Queries that put several operators together: scans with warnings, verification, plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chains as ch
from ..operators import files as fl
from ..operators import ranges as rg
from ..operators import verify as vf
from ..sources import table
from . import bind
from .bind import CHUNKS, ENTRIES, LISTING, MEM, NEWEST, SCANS
from .chain_queries import _COMPLETE, _complete

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {SCANS}, w AS (SELECT image_uuid, scanned_unix, unnest([CASE WHEN set_name IS NULL THEN 'no_set_name' END, CASE WHEN size_bytes IS NULL OR size_bytes < 0 THEN 'size' END, CASE WHEN NOT coalesce(chunk_size BETWEEN 262144 AND 4194304 AND chunk_size & (chunk_size - 1) = 0, false) THEN 'chunk_size' END,
CASE WHEN seq_in_chain IS NULL OR seq_in_chain < 0 THEN 'seq' END, CASE WHEN image_uuid = parent_uuid THEN 'own_parent' END, CASE WHEN file_name IS NULL THEN 'no_file_name' END]) AS warning FROM scans) SELECT DISTINCT * FROM w WHERE warning IS NOT NULL""")
def set_scan_warnings(spark, d):
    """Scanned headers that can be read but do not add up, as rows."""
    tests = [(F.col("set_name").isNull(), "no_set_name"), (F.col("size_bytes").isNull() | (F.col("size_bytes") < 0), "size"), (~F.coalesce(tx.valid_chunk_size(F.col("chunk_size")), F.lit(False)), "chunk_size"), (F.col("seq_in_chain").isNull() | (F.col("seq_in_chain") < 0), "seq"), (F.col("image_uuid") == F.col("parent_uuid"), "own_parent"), (F.col("file_name").isNull(), "no_file_name")]
    rows = bind.scans(spark, d).select("image_uuid", "scanned_unix", F.explode(F.array(*[F.when(t, n) for t, n in tests])).alias("warning"))
    return rows.where("warning is not null").distinct()


@query(f"""WITH {ENTRIES}, {NEWEST}, {CHUNKS}, c AS (SELECT chain_id, member_seq, chunk_offset, max_by(chunk_id, (batch_no, chunk_id)) AS chunk_id FROM ck GROUP BY 1, 2, 3)
SELECT n.chain_id, count(*) AS n_planned, count(c.chunk_id) AS n_found FROM newest n LEFT JOIN c ON c.chain_id = n.chain_id AND c.member_seq = n.seq AND c.chunk_offset = n.plan_offset GROUP BY 1""")
def payload_fetch(spark, d):
    """Merged entries with the record that holds their payload: an equi-join on chain, member and offset."""
    held = bind.chunks(spark, d).groupBy("chain_id", F.col("member_seq").cast("int").alias("seq"), F.col("chunk_offset").alias("plan_offset")).agg(F.max(F.struct("batch_no", "chunk_id")).alias("c"))
    return bind.newest(spark, d).join(held, ["chain_id", "seq", "plan_offset"], "left").groupBy("chain_id").agg(F.count("*").alias("n_planned"), F.count("c").alias("n_found"))


@query(f"""WITH {ENTRIES}, {NEWEST}, m AS (SELECT chain_id, count(*) AS n_merged, sum(plan_len) AS merged_bytes, count(*) FILTER (state = 3) AS n_bad FROM newest GROUP BY 1), o AS (SELECT chain_id, count(*) AS n_own, sum(plan_len) AS own_bytes FROM entries GROUP BY 1)
SELECT chain_id, n_merged, n_own, n_merged + n_own AS n_checked, CAST(merged_bytes + own_bytes AS BIGINT) AS bytes_checked, n_bad FROM m JOIN o USING (chain_id)""")
def verify_report(spark, d):
    """What a chain verification reads: merged and own payloads both count."""
    m = bind.newest(spark, d).groupBy("chain_id").agg(F.count("*").alias("n_merged"), F.sum("plan_len").alias("mb"), F.count(F.when(F.col("state") == ch.BAD, 1)).alias("n_bad"))
    o = bind.entries(spark, d).groupBy("chain_id").agg(F.count("*").alias("n_own"), F.sum("plan_len").alias("ob"))
    return m.join(o, "chain_id").select("chain_id", "n_merged", "n_own", (F.col("n_merged") + F.col("n_own")).alias("n_checked"), (F.col("mb") + F.col("ob")).alias("bytes_checked"), "n_bad")


@query(f"WITH {_COMPLETE} SELECT set_id, chain_id, row_number() OVER (PARTITION BY set_id ORDER BY created_unix NULLS FIRST, chain_id) AS age_rank FROM comp")
def chains_oldest_first(spark, d):
    return _complete(spark, d).select("set_id", "chain_id", F.row_number().over(Window.partitionBy("set_id").orderBy("created_unix", "chain_id")).alias("age_rank"))


@query(f"""WITH {ENTRIES}, e AS (SELECT chain_id, seq, region, min(plan_offset) FILTER (plan_len > 0) AS lo, max(plan_offset + plan_len - 1) FILTER (plan_len > 0) AS hi FROM entries GROUP BY 1, 2, 3)
SELECT chain_id, seq, region, coalesce(lo, 0) + region * {1 << 50} AS start, coalesce(hi, {(1 << 50) - 1}) + region * {1 << 50} AS end_incl, lo IS NOT NULL AS is_complete FROM e""")
def region_source_map(spark, d):
    """What is read of each region, in device bytes; a region of which nothing is known is read as a whole."""
    some = F.col("plan_len") > 0
    e = bind.entries(spark, d).groupBy("chain_id", "seq", "region").agg(F.min(F.when(some, F.col("plan_offset"))).alias("lo"), F.max(F.when(some, F.col("plan_offset") + F.col("plan_len") - 1)).alias("hi"))
    at = F.col("region") * (1 << 50)
    return e.select("chain_id", "seq", "region", (F.coalesce("lo", F.lit(0)) + at).alias("start"), (F.coalesce("hi", F.lit((1 << 50) - 1)) + at).alias("end_incl"), F.col("lo").isNotNull().alias("is_complete"))


@query(f"""WITH {LISTING}, x AS (SELECT l.chain_id, l.seq, decode(l.path) AS path, CASE WHEN file_kind = 1 AND size IS NULL THEN 'no_size' WHEN file_kind <> 1 AND size > 0 AND file_kind <> 3 THEN 'size_without_content' WHEN file_kind = 3 AND coalesce(octet_length(link_target), 0) = 0 THEN 'no_target' WHEN file_kind <> 3 AND octet_length(link_target) > 0 THEN 'target_without_link' END AS check_id FROM listing l)
SELECT * FROM x WHERE check_id IS NOT NULL""")
def tree_violations(spark, d):
    """Records whose fields do not fit their kind."""
    k, n, t = F.col("file_kind"), F.col("size"), F.length("link_target")
    bad = F.when((k == fl.REGULAR) & n.isNull(), "no_size").when((k != fl.REGULAR) & (n > 0) & (k != fl.SYMLINK), "size_without_content").when((k == fl.SYMLINK) & (F.coalesce(t, F.lit(0)) == 0), "no_target").when((k != fl.SYMLINK) & (t > 0), "target_without_link")
    rows = bind.listing(spark, d).select(bind.chain_text().alias("chain_id"), "seq", F.decode("path", "UTF-8").alias("path"), bad.alias("check_id"))
    return rows.where("check_id is not null")


@query("""WITH h AS (SELECT DISTINCT entry_id, size, unnest(holes) AS hole FROM file_entries WHERE holes IS NOT NULL), p AS (SELECT DISTINCT entry_id, size, i * 65536 AS lo, least((i + 1) * 65536, size) - 1 AS hi FROM (SELECT entry_id, size, unnest(range((size + 65535) // 65536)) AS i FROM (SELECT DISTINCT entry_id, size FROM h)))
SELECT DISTINCT p.entry_id, p.size, lo // 65536 AS chunk_no, greatest(lo, hole.hole_offset) AS clip_start, least(hi, hole.hole_offset + hole.hole_len - 1) AS clip_end FROM p JOIN h ON h.entry_id = p.entry_id AND h.size = p.size AND hole.hole_offset <= hi AND hole.hole_offset + hole.hole_len - 1 >= lo""")
def hole_overlap(spark, d):
    """Parts of each file's 64 KiB chunks that lie in a hole."""
    h = table(spark, d, "file_entries").where("holes is not null").select("entry_id", "size", F.explode("holes").alias("h")).distinct()
    holes = h.select("entry_id", "size", F.col("h.hole_offset").alias("start"), (F.col("h.hole_offset") + F.col("h.hole_len") - 1).alias("end_incl"))
    files = h.select("entry_id", "size").distinct().where("size > 0")
    parts = files.select("entry_id", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), rg.idiv(F.col("size") - 1, 65536))).alias("chunk_no")).withColumn("lo", F.col("chunk_no") * 65536).withColumn("hi", F.least((F.col("chunk_no") + 1) * 65536, "size") - 1)
    return rg.overlap_join(holes, parts, ["entry_id", "size"], 65536).select("entry_id", "size", "chunk_no", "clip_start", "clip_end").distinct()


@query(f"WITH {MEM} SELECT image_uuid, CASE WHEN source_size_bytes IS NULL OR chunk_size IS NULL OR chunk_size <= 0 THEN NULL ELSE (source_size_bytes + chunk_size - 1) // chunk_size END AS n_chunks FROM (SELECT mem.image_uuid, mem.chunk_size, s.source_size_bytes FROM mem JOIN (SELECT image_uuid, max(source_size_bytes) AS source_size_bytes FROM scans GROUP BY 1) s USING (image_uuid))")
def chunk_counts(spark, d):
    sizes = bind.scans(spark, d).groupBy("image_uuid").agg(F.max("source_size_bytes").alias("source_size_bytes"))
    n = F.call_function("div", F.col("source_size_bytes") + F.col("chunk_size") - 1, F.col("chunk_size").cast("bigint"))
    return bind.members(spark, d).join(sizes, "image_uuid").select("image_uuid", F.when(F.col("chunk_size") > 0, n).alias("n_chunks"))


_VERDICTS = f"""{CHUNKS}, rec AS (SELECT chain_id, member_seq AS seq, chunk_offset AS plan_offset, max_by({{'v': CASE WHEN payload IS NULL THEN 'no_content' WHEN octet_length(payload) < plain_len THEN 'short' WHEN hash IS NULL THEN 'no_hash' WHEN lower(hash) = sha256(payload) THEN 'equal' ELSE 'stale' END, 'n': octet_length(payload)}}, (batch_no, chunk_id)) AS r FROM ck GROUP BY 1, 2, 3)"""


def _records(spark, d):
    return bind.chunks(spark, d).select("chain_id", F.col("member_seq").cast("int").alias("seq"), F.col("chunk_offset").alias("plan_offset"), "batch_no", "chunk_id", "hash", "payload", "plain_len")


_PLACE = ["chain_id", "seq", "plan_offset"]


def _checked(spark, d, entries):
    return vf.payload_verdicts(entries, _records(spark, d), _PLACE, ["batch_no", "chunk_id"], "hash", "payload", "plain_len")


@query(f"""WITH {ENTRIES}, {NEWEST}, {_VERDICTS} SELECT n.chain_id, coalesce(rec.r.v, 'missing') AS verdict, count(*) AS n_chunks, CAST(sum(coalesce(rec.r.n, 0)) AS BIGINT) AS n_bytes FROM newest n LEFT JOIN rec ON rec.chain_id = n.chain_id AND rec.seq = n.seq AND rec.plan_offset = n.plan_offset WHERE n.state IN (1, 3) GROUP BY 1, 2""")
def chain_verification(spark, d):
    """The merged state of each chain, every payload read and hashed."""
    return _checked(spark, d, bind.newest(spark, d).where(F.col("state").isin(ch.STORED, ch.BAD))).groupBy("chain_id", "verdict").agg(F.count("*").alias("n_chunks"), F.sum("n_bytes").cast("bigint").alias("n_bytes"))


@query(f"""WITH {ENTRIES}, {_VERDICTS} SELECT e.chain_id, e.seq, coalesce(rec.r.v, 'missing') AS verdict, count(*) AS n_chunks FROM entries e LEFT JOIN rec ON rec.chain_id = e.chain_id AND rec.seq = e.seq AND rec.plan_offset = e.plan_offset WHERE e.state IN (1, 3) GROUP BY 1, 2, 3""")
def member_verification(spark, d):
    """Every member's own payloads, those that later members replaced included."""
    return _checked(spark, d, bind.entries(spark, d).where(F.col("state").isin(ch.STORED, ch.BAD))).groupBy("chain_id", "seq", "verdict").agg(F.count("*").alias("n_chunks"))


@query(f"WITH {ENTRIES}, {NEWEST} SELECT chain_id, seq, count(*) AS n_chunks, CAST(sum(plan_len) AS BIGINT) AS n_bytes FROM newest WHERE state = 1 GROUP BY 1, 2")
def restore_members(spark, d):
    """The members that a restore of each chain's newest state reads."""
    return vf.restore_members(bind.newest(spark, d), ["chain_id"], "seq", "plan_len", F.col("state") == ch.STORED)


@query(f"""WITH {_COMPLETE}, {ENTRIES}, {NEWEST}, {_VERDICTS}, s AS (SELECT n.chain_id, n.state, coalesce(rec.r.v, 'missing') AS v FROM newest n LEFT JOIN rec ON rec.chain_id = n.chain_id AND rec.seq = n.seq AND rec.plan_offset = n.plan_offset WHERE n.state IN (1, 3))
SELECT chain_id, 'incomplete' AS refusal, n AS n_cases FROM (SELECT chain_id, CAST(1 AS BIGINT) AS n FROM comp WHERE NOT is_complete) UNION ALL SELECT chain_id, 'no_members', CAST(1 AS BIGINT) FROM (SELECT DISTINCT chain_id FROM newest) WHERE chain_id NOT IN (SELECT chain_id FROM comp WHERE chain_id IS NOT NULL)
UNION ALL SELECT chain_id, 'bad_chunks', count(*) FROM s WHERE state = 3 GROUP BY 1 UNION ALL SELECT chain_id, 'payload_' || v, count(*) FROM s WHERE state = 1 AND v <> 'equal' GROUP BY 1, v""")
def restore_refusals(spark, d):
    """Why the newest state of a chain can't be restored as a whole, as rows: chains that are incomplete or unknown, bad chunks
    and payloads that are missing or don't hash to what was stored."""
    one = F.lit(1).cast("bigint").alias("n_cases")
    comp, state = _complete(spark, d), bind.newest(spark, d)
    held = _checked(spark, d, state.where(F.col("state").isin(ch.STORED, ch.BAD)))
    bad = F.when(F.col("state") == ch.BAD, F.lit("bad_chunks")).when(F.col("verdict") != "equal", F.concat(F.lit("payload_"), "verdict"))
    faults = held.select("chain_id", bad.alias("refusal")).where("refusal is not null").groupBy("chain_id", "refusal").agg(F.count("*").alias("n_cases"))
    unknown = state.select("chain_id").distinct().join(comp.select("chain_id"), "chain_id", "left_anti").select("chain_id", F.lit("no_members").alias("refusal"), one)
    return comp.where("not is_complete").select("chain_id", F.lit("incomplete").alias("refusal"), one).unionByName(unknown).unionByName(faults)


@query(f"""WITH {ENTRIES}, e AS (SELECT chain_id, seq, region, min(plan_offset) AS s, max(plan_offset + plan_len - 1) AS t FROM entries WHERE plan_len > 0 GROUP BY 1, 2, 3),
w AS (SELECT chain_id, seq, region, s AS start, max(t) OVER (PARTITION BY chain_id, seq ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e) SELECT * FROM w WHERE start <= reach""")
def region_order_breaks(spark, d):
    """Regions of a layout that begin before an earlier one ends."""
    e = bind.entries(spark, d).where("plan_len > 0").groupBy("chain_id", "seq", "region").agg(F.min("plan_offset").alias("start"), F.max(F.col("plan_offset") + F.col("plan_len") - 1).alias("end_incl"))
    return vf.order_breaks(e, ["chain_id", "seq"], "region", "start", "end_incl")


@query(f"WITH {CHUNKS}, h AS (SELECT chain_id, lower(hash) AS hash, count(*) AS n_records FROM ck WHERE hash IS NOT NULL GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY hash) - 1 AS position FROM h")
def hash_index(spark, d):
    """The sorted index of the hashes of each chain."""
    return vf.hash_index(bind.chunks(spark, d), ["chain_id"], "hash")


@query(f"""WITH {CHUNKS} SELECT chain_id, member_seq, count(*) AS n_chunks, count(DISTINCT lower(hash)) AS n_distinct, CAST(sum(plain_len) AS BIGINT) AS plain_bytes, CAST(sum(octet_length(payload)) AS BIGINT) AS stored_bytes, max(chunk_offset + plain_len) AS stream_end FROM ck GROUP BY 1, 2""")
def stream_rollup(spark, d):
    """Totals of each member's record stream."""
    c = bind.chunks(spark, d)
    return c.groupBy("chain_id", "member_seq").agg(F.count("*").alias("n_chunks"), F.countDistinct(F.lower("hash")).alias("n_distinct"), F.sum("plain_len").cast("bigint").alias("plain_bytes"), F.sum(F.length("payload")).cast("bigint").alias("stored_bytes"), F.max(F.col("chunk_offset") + F.col("plain_len")).alias("stream_end"))


@query(f"WITH {MEM} SELECT set_id, count(*) AS n_members, count(DISTINCT chain_id) AS n_chains, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, max(created_unix) AS newest_unix FROM mem WHERE is_whole_disk GROUP BY 1")
def whole_disk_totals(spark, d):
    """Members of whole disks per set."""
    return bind.members(spark, d).where("is_whole_disk").groupBy("set_id").agg(F.count("*").alias("n_members"), F.countDistinct("chain_id").alias("n_chains"), F.sum("size_bytes").alias("size_bytes"), F.max("created_unix").alias("newest_unix"))


@query(f"WITH {MEM} SELECT b.destination, count(DISTINCT mem.chain_id) AS n_devices, count(DISTINCT mem.set_id) AS n_sets FROM mem JOIN backup_sets b ON b.set_id = mem.set_id GROUP BY 1")
def destination_devices(spark, d):
    """Distinct chains and sets that write to each destination."""
    sets = table(spark, d, "backup_sets").select("set_id", "destination")  # fixed table of 40 rows
    return bind.members(spark, d).join(F.broadcast(sets), "set_id").groupBy("destination").agg(F.countDistinct("chain_id").alias("n_devices"), F.countDistinct("set_id").alias("n_sets"))
