"""Queries over ranges, traces, jobs and devices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import devices as dv
from ..operators import jobs as jb
from ..operators import ranges as rg
from ..operators import tracking as tr
from ..sources import table
from . import bind
from .bind import CHUNKS, ENTRIES, LISTING, MEM

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BY = ["chain_id", "seq", "region"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _extents(spark, d):
    return bind.entries(spark, d).where("plan_len > 0").select(*BY, F.col("plan_offset").alias("start"), (F.col("plan_offset") + F.col("plan_len") - 1).alias("end_incl"))


def _device_ends(extents):
    """Extents with the size of their device: the end of the furthest read that any snapshot of the chain plans in the region."""
    ends = extents.groupBy("chain_id", "region").agg((F.max("end_incl") + 1).alias("size"))
    return extents.join(ends, ["chain_id", "region"])


_EXT = f"{ENTRIES}, ext AS (SELECT chain_id, seq, region, plan_offset AS start, plan_offset + plan_len - 1 AS end_incl FROM entries WHERE plan_len > 0 AND plan_offset IS NOT NULL)"


def _merged(source: str, name: str, by: str = "chain_id, seq, region") -> str:
    return f"""{name} AS (SELECT {by}, min(start) AS start, max(end_incl) AS end_incl FROM (SELECT *, sum(CASE WHEN start <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY {by} ORDER BY start, end_incl, reach NULLS FIRST ROWS UNBOUNDED PRECEDING) AS isle
  FROM (SELECT *, max(end_incl) OVER (PARTITION BY {by} ORDER BY start, end_incl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source} WHERE end_incl >= start)) GROUP BY {by}, isle)"""


_MERGED = f"{_EXT}, {_merged('ext', 'mg')}"


@query(f"WITH {_MERGED} SELECT * FROM mg")
def extents_merge(spark, d):
    return rg.merge_ranges(_extents(spark, d), BY)


@query(f"""WITH {_EXT}, v AS (SELECT *, CASE WHEN end_incl < start THEN 'reversed' WHEN start <= max(end_incl) OVER (PARTITION BY chain_id, seq, region ORDER BY start, end_incl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'overlap' END AS check_id FROM ext) SELECT * FROM v WHERE check_id IS NOT NULL""")
def extents_strict_violations(spark, d):
    return rg.range_violations(_extents(spark, d), BY)


_COMPL = f"""{_MERGED}, g AS (SELECT chain_id, seq, region, coalesce(lag(end_incl) OVER (PARTITION BY chain_id, seq, region ORDER BY start) + 1, 0) AS start, start - 1 AS end_incl FROM mg
UNION ALL SELECT chain_id, seq, region, max(end_incl) + 1, {1 << 62} FROM mg GROUP BY 1, 2, 3), co AS (SELECT * FROM g WHERE start <= end_incl)"""


@query(f"WITH {_COMPL} SELECT * FROM co")
def extents_complement(spark, d):
    return rg.complement(_extents(spark, d), BY, F.lit(0).cast("bigint"), F.lit(1 << 62))


@query(f"WITH {ENTRIES}, b AS (SELECT chain_id, seq, region, chunk_index AS start, chunk_index AS end_incl FROM entries), {_merged('b', 'mg')} SELECT chain_id, seq, region, start * {bind.CHUNK} AS start, (end_incl + 1) * {bind.CHUNK} - 1 AS end_incl FROM mg")
def extents_scale(spark, d):
    blocks = bind.entries(spark, d).select(*BY, F.col("chunk_index").alias("start"), F.col("chunk_index").alias("end_incl"))
    return rg.scale(rg.merge_ranges(blocks, BY), bind.CHUNK)


_UNIT = 4 * bind.CHUNK
_ENDS = f"{_EXT}, dev AS (SELECT *, max(end_incl) OVER (PARTITION BY chain_id, region) + 1 AS size FROM ext)"
_ALIGN = f"""{_ENDS}, aw AS (SELECT chain_id, seq, region, (start // {_UNIT}) * {_UNIT} AS start, least((end_incl // {_UNIT} + 1) * {_UNIT}, size) - 1 AS end_incl FROM dev), {_merged('aw', 'al')}"""


@query(f"WITH {_ALIGN} SELECT * FROM al")
def chunk_align(spark, d):
    return rg.align(_device_ends(_extents(spark, d)), _UNIT, F.col("size"), BY)


@query(f"WITH {_ALIGN}, p AS (SELECT chain_id, seq, region, end_incl, unnest(range(start, end_incl + 1, {_UNIT})) AS plan_offset FROM al) SELECT chain_id, seq, region, plan_offset // {_UNIT} AS chunk_index, plan_offset, least({_UNIT}, end_incl - plan_offset + 1) AS plan_len FROM p")
def chunk_plan_rows(spark, d):
    return rg.chunk_plan(chunk_align(spark, d), _UNIT, BY)


@query(f"WITH {_MERGED} SELECT chain_id, seq, region, count(*) AS n_ranges, CAST(sum(end_incl - start + 1) AS BIGINT) AS covered_bytes, CAST(sum((end_incl - start + {bind.CHUNK}) // {bind.CHUNK}) AS BIGINT) AS planned_chunks FROM mg GROUP BY 1, 2, 3")
def extent_totals(spark, d):
    return rg.totals(rg.merge_ranges(_extents(spark, d), BY), bind.CHUNK, BY)


@query(f"WITH {_COMPL}, a AS (SELECT chain_id, seq, region, sum(end_incl - start + 1) AS used FROM mg GROUP BY 1, 2, 3), b AS (SELECT chain_id, seq, region, sum(end_incl - start + 1) AS free FROM co GROUP BY 1, 2, 3) SELECT chain_id, seq, region, used + free = {(1 << 62) + 1} AS is_reconciled FROM a JOIN b USING (chain_id, seq, region)")
def extent_reconciliation(spark, d):
    used = rg.merge_ranges(_extents(spark, d), BY).withColumn("side", F.lit("used")).unionByName(extents_complement(spark, d).withColumn("side", F.lit("free")))
    return used.groupBy(*BY).agg((F.sum(F.col("end_incl") - F.col("start") + 1) == (1 << 62) + 1).alias("is_reconciled"))


@query(f"""WITH {ENTRIES}, s AS (SELECT DISTINCT chain_id, seq, region, chunk_index AS i FROM entries), g AS (SELECT chain_id, seq, region, coalesce(lag(i) OVER (PARTITION BY chain_id, seq, region ORDER BY i), -1) + 1 AS first_missing, i - 1 AS last_missing FROM s) SELECT * FROM g WHERE first_missing <= last_missing""")
def plan_index_gaps(spark, d):
    return rg.index_gaps(bind.entries(spark, d), BY, "chunk_index")


_EVENTS = """io AS (SELECT event_id, ts, CAST(user_id % 4 AS VARCHAR) AS dev, CASE event_type WHEN 'view' THEN 'R' WHEN 'click' THEN 'W' WHEN 'purchase' THEN 'FWS' WHEN 'signup' THEN 'D' ELSE 'FR' END AS flags, CAST(floor(value * 100) AS BIGINT) AS sector, event_id % 64 AS sectors FROM events)"""
_REGIONS = "rgn AS (SELECT CAST(c0 AS VARCHAR) AS dev, c0 * 10 + c1 AS region, c1 * 10000 AS lo, c1 * 10000 + 9999 AS hi FROM (SELECT unnest(range(4)) AS c0), (SELECT unnest(range(5)) AS c1))"


def _io(spark, d):
    kinds = {"view": "R", "click": "W", "purchase": "FWS", "signup": "D"}
    return table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 4).cast("string").alias("dev"), F.coalesce(tx.lookup(kinds, F.col("event_type")), F.lit("FR")).alias("flags"), F.floor(F.col("value") * 100).alias("sector"), (F.col("event_id") % 64).alias("sectors"))


def _regions(spark):
    return spark.range(20).select((F.col("id") % 4).cast("string").alias("dev"), F.lit(None).cast("string").alias("part_dev"), (F.col("id") % 4 * 10 + F.floor(F.col("id") / 4)).alias("region"), (F.floor(F.col("id") / 4) * 10_000).alias("lo"), (F.floor(F.col("id") / 4) * 10_000 + 9999).alias("hi"))


_DIRTY = f"""{_EVENTS}, {_REGIONS}, hit AS (SELECT dev, sector AS s, sector + sectors - 1 AS e FROM io WHERE sectors <> 0 AND NOT regexp_matches(CASE WHEN flags LIKE 'F%' AND length(flags) > 1 THEN substr(flags, 2) ELSE flags END, '^R')),
ov AS (SELECT region, greatest(s, lo) - lo AS a, least(e, hi) - lo AS b FROM hit JOIN rgn ON hit.dev = rgn.dev AND s <= hi AND e >= lo), dirty AS (SELECT DISTINCT region, unnest(range(a // 8, b // 8 + 1)) AS chunk_no FROM ov)"""


@query(f"WITH {_DIRTY} SELECT region, chunk_no FROM dirty")
def dirty_chunks(spark, d):
    return tr.dirty_chunks(_io(spark, d), _regions(spark), 8)


@query(f"WITH {_DIRTY} SELECT DISTINCT region, chunk_no // 16 AS chunk_no FROM dirty")
def dirty_coarsen(spark, d):
    return tr.coarsen(dirty_chunks(spark, d), 16)


@query(f"WITH {_DIRTY} SELECT region, count(*) AS n_dirty FROM dirty GROUP BY 1")
def dirty_bitmap_union(spark, d):
    maps = tr.bitmaps(dirty_chunks(spark, d))
    return tr.bitmap_union(maps.unionByName(maps)).groupBy("region").agg(F.sum("n_dirty").alias("n_dirty"))


@query(f"""WITH {_EVENTS}, b AS (SELECT epoch_us(min(ts)) // 1800000000 AS f, epoch_us(max(ts)) // 1800000000 AS l FROM events), w AS (SELECT dev, make_timestamp(y * 1800000000) AS t0, make_timestamp((y + 1) * 1800000000) AS t1 FROM (SELECT DISTINCT dev FROM io WHERE dev IS NOT NULL), (SELECT unnest(range(f, l + 1)) AS y FROM b))
SELECT w.dev, t0, t1, count(ts) AS n_writes, count(ts) = 0 AS is_quiet FROM w LEFT JOIN (SELECT * FROM io WHERE sectors <> 0 AND flags IN ('W', 'FWS', 'D')) i ON i.dev = w.dev AND ts BETWEEN t0 AND t1 GROUP BY 1, 2, 3""")
def quiet_windows(spark, d):
    io, half = _io(spark, d), 1800
    first, last = (rg.idiv(F.unix_seconds(f("ts").cast("timestamp")), half) * half for f in (F.min, F.max))
    starts = io.agg(first.alias("first"), last.alias("last")).where("first is not null").select(F.explode(F.sequence("first", "last", F.lit(half).cast("bigint"))).alias("s"))
    devices = io.where("dev is not null").select("dev").distinct()
    windows = devices.crossJoin(starts).select("dev", F.timestamp_seconds("s").alias("t0"), F.timestamp_seconds(F.col("s") + half).alias("t1"))
    return tr.quiet(io, windows)


@query("""WITH l AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 3600000000 THEN 1 ELSE 0 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS burst FROM l) SELECT user_id, CAST(burst AS BIGINT) AS burst, min(ts) AS started, max(ts) AS ended, count(*) AS n_events FROM s GROUP BY 1, 2""")
def event_bursts(spark, d):
    return tr.sessions(table(spark, d, "events"), ["user_id"], "ts", 3600)


@query("SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def job_last_state(spark, d):
    return jb.last_state(table(spark, d, "events"), ["user_id"], "ts", "event_id", ["event_type", "value"])


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_no FROM events")
def job_event_numbers(spark, d):
    return jb.numbered(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_no")


@query("""WITH m AS (SELECT *, lag(event_id) OVER w IS NULL OR event_type IS DISTINCT FROM lag(event_type) OVER w AS moved FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stalled_from, ts AS stalled_until FROM m WHERE moved) SELECT * FROM g WHERE epoch_us(stalled_until) - epoch_us(stalled_from) > 28800000000""")
def job_stalls(spark, d):
    return jb.stalls(table(spark, d, "events"), ["user_id"], "ts", "event_id", ["event_type"], 8 * 3600)


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, row_number() OVER w AS event_no, CAST(sum(CAST(trunc(value * 100) AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done, CAST(sum(CAST(trunc(value * 100) AS BIGINT)) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT job_id, event_no, done, total, done >= 100000 OR (done = total AND done > 0) AS emit, CASE WHEN done >= 100000 OR (done = total AND done > 0) THEN done ELSE 0 END AS told FROM e WHERE event_no = 1
UNION ALL SELECT e.job_id, e.event_no, e.done, e.total, e.done - f.told >= 100000 OR (e.done = e.total AND e.done > f.told), CASE WHEN e.done - f.told >= 100000 OR (e.done = e.total AND e.done > f.told) THEN e.done ELSE f.told END FROM f JOIN e ON e.job_id = f.job_id AND e.event_no = f.event_no + 1)
SELECT job_id, event_no, done, total FROM f WHERE emit""")
def progress_throttle(spark, d):
    e = jb.numbered(table(spark, d, "events"), ["user_id"], "ts", "event_id").withColumn("job_id", F.col("user_id").cast("string"))
    from pyspark.sql import Window

    line = Window.partitionBy("job_id").orderBy("event_no")
    done = F.sum((F.col("value") * 100).cast("bigint")).over(line)
    total = F.sum((F.col("value") * 100).cast("bigint")).over(Window.partitionBy("job_id"))
    return jb.throttled(e.select("job_id", "event_no", done.alias("done"), total.alias("total")), 100_000)


@query("SELECT set_id, created_unix, keep_chains FROM backup_sets WHERE keep_chains <> 0 AND 1735689600 > created_unix + keep_chains * 8640000")
def stale_leases(spark, d):
    leases = table(spark, d, "backup_sets").select("set_id", "created_unix", "keep_chains", F.col("created_unix").alias("created"), (F.col("keep_chains") * 8_640_000).alias("ttl"))
    return jb.stale(leases, 1735689600).select("set_id", "created_unix", "keep_chains")


@query(f"""WITH {MEM}, i AS (SELECT chain_id AS device, 'file_name' AS kind, lower(file_name) AS identity FROM mem UNION ALL SELECT chain_id, 'set_id', lower(set_id) FROM mem)
SELECT kind, identity, count(DISTINCT device) AS n_devices, min(device) AS first_device FROM i WHERE identity <> '' GROUP BY 1, 2 HAVING count(DISTINCT device) > 1""")
def duplicate_identity(spark, d):
    return dv.duplicate_identities(bind.members(spark, d), "chain_id", ["file_name", "set_id"])


@query(f"""WITH {LISTING}, p AS (SELECT chain_id, seq, decode(path) AS path, file_kind FROM listing), m AS (SELECT chain_id, seq, path FROM p WHERE file_kind = 2)
SELECT DISTINCT p.chain_id, p.seq, p.path FROM p LEFT JOIN m x ON x.chain_id = p.chain_id AND x.seq = p.seq AND x.path = p.path WHERE x.path IS NULL AND EXISTS (SELECT 1 FROM m WHERE m.chain_id = p.chain_id AND m.seq = p.seq AND starts_with(p.path, m.path || '/'))""")
def nested_unmounted(spark, d):
    rows = bind.listing(spark, d).select(bind.chain_text().alias("chain_id"), "seq", F.decode("path", "UTF-8").alias("path"), "file_kind")
    return dv.nested_unmounted(rows.select("chain_id", "seq", "path"), rows.where("file_kind = 2").select("chain_id", "seq", "path"), ["chain_id", "seq"])


@query("""WITH x AS (SELECT r_name AS name, NULL AS parent, NULL AS number FROM region UNION ALL SELECT n_name, r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT name, coalesce(parent, name) AS disk, row_number() OVER (PARTITION BY coalesce(parent, name) ORDER BY number NULLS FIRST) AS place FROM x""")
def device_hierarchy(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    kids = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"), F.col("n_nationkey").alias("number"))
    return dv.hierarchy_order(r.select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("number")).unionByName(kids)).select("name", "disk", "place")


@query("SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT m)), ',') AS mounts FROM (SELECT c_nationkey, c_mktsegment AS m FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier) GROUP BY 1")
def merged_mountpoints(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    rows = c.select("c_nationkey", F.col("c_mktsegment").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(s.select(F.col("s_nationkey").alias("c_nationkey"), F.lit(None).cast("string").alias("a"), F.col("s_name").alias("b")))
    return dv.merged_mountpoints(rows, ["c_nationkey"], ["a", "b"]).select("c_nationkey", F.array_join("mountpoints", ",").alias("mounts"))


@query(f"""WITH {ENTRIES}, a AS (SELECT *, row_number() OVER (PARTITION BY chain_id, seq ORDER BY region, chunk_index, plan_id) - 1 AS pos FROM entries), b AS (SELECT * REPLACE (seq + 1 AS seq) FROM a)
SELECT coalesce(a.chain_id, b.chain_id) AS chain_id, coalesce(a.seq, b.seq) AS seq, min(coalesce(a.pos, b.pos)) AS first_difference FROM a FULL JOIN b ON a.chain_id = b.chain_id AND a.seq = b.seq AND a.pos = b.pos WHERE a.pos IS NULL OR b.pos IS NULL OR a.region <> b.region OR a.chunk_index <> b.chunk_index GROUP BY 1, 2""")
def layout_difference(spark, d):
    e = bind.entries(spark, d)
    return dv.layout_difference(e, e.withColumn("seq", F.col("seq") + 1), ["chain_id", "seq"], ["region", "chunk_index", "plan_id"], ["region", "chunk_index"])


@query(f"""WITH {_ENDS}, w AS (SELECT chain_id, seq, region, size, start, max(end_incl) OVER (PARTITION BY chain_id, seq, region ORDER BY start, end_incl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM dev),
g AS (SELECT chain_id, seq, region, size, coalesce(e + 1, 0) AS gap_start, start - 1 AS gap_end FROM w UNION ALL SELECT chain_id, seq, region, max(size), max(end_incl) + 1, max(size) - 1 FROM dev GROUP BY 1, 2, 3)
SELECT chain_id, seq, region, gap_start, gap_end FROM g WHERE gap_end >= gap_start AND CAST(gap_end - gap_start + 1 AS DOUBLE) >= CAST(0.02 AS DOUBLE) * size""")
def disk_gaps(spark, d):
    return dv.unallocated(_device_ends(_extents(spark, d)), BY, F.col("size"))


@query("""WITH t AS (SELECT n_regionkey AS disk, n_nationkey AS part, (n_nationkey + 1.0) / sum(n_nationkey + 1.0) OVER (PARTITION BY n_regionkey) AS share, least(0.08, 1.0 / count(*) OVER (PARTITION BY n_regionkey)) AS fl FROM nation),
u AS (SELECT *, sum(CASE WHEN share < fl THEN fl ELSE 0 END) OVER (PARTITION BY disk) AS small, sum(CASE WHEN share < fl THEN 0 ELSE share END) OVER (PARTITION BY disk) AS large FROM t)
SELECT disk, part, CAST(round(1e6 * (CASE WHEN share < fl THEN fl ELSE share * (1 - small) / large END)) AS BIGINT) AS width_ppm FROM u""")
def tile_widths(spark, d):
    from pyspark.sql import Window

    n = F.col("n_nationkey") + 1.0
    tiles = table(spark, d, "nation").select(F.col("n_regionkey").alias("disk"), F.col("n_nationkey").alias("part"), (n / F.sum(n).over(Window.partitionBy("n_regionkey"))).alias("share"))
    return dv.tile_widths(tiles, ["disk"], "share").select("disk", "part", F.round(F.col("width") * 1e6).cast("bigint").alias("width_ppm"))


@query(f"""WITH {CHUNKS}, {ENTRIES}, {_merged("(SELECT chain_id, seq, plan_offset AS start, plan_offset + plan_len - 1 AS end_incl FROM entries WHERE plan_len > 0)", 'mg', 'chain_id, seq')}
SELECT chunk_id, mg.seq, greatest(chunk_offset, start) AS clip_start, least(chunk_offset + plain_len - 1, end_incl) AS clip_end FROM ck JOIN mg ON ck.chain_id = mg.chain_id AND ck.member_seq = mg.seq AND chunk_offset <= end_incl AND chunk_offset + plain_len - 1 >= start WHERE plain_len > 0""")
def planned_overlap(spark, d):
    reads = bind.entries(spark, d).where("plan_len > 0").select("chain_id", "seq", F.col("plan_offset").alias("start"), (F.col("plan_offset") + F.col("plan_len") - 1).alias("end_incl"))
    on = ["chain_id", "seq"]
    areas = rg.merge_ranges(reads, on).select(*on, F.col("start").alias("lo"), F.col("end_incl").alias("hi"))
    points = bind.chunks(spark, d).select("chunk_id", "chain_id", F.col("member_seq").cast("int").alias("seq"), F.col("chunk_offset").alias("start"), (F.col("chunk_offset") + F.col("plain_len") - 1).alias("end_incl"))
    return rg.overlap_join(points, areas, on, 256 * bind.CHUNK).select("chunk_id", "seq", "clip_start", "clip_end")
