"""Queries over file trees, content, chunking, texts of tools and scalar functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking as ck
from ..operators import files as fl
from ..operators import ranges as rg
from ..session import cut
from ..sources import parsers, table
from . import bind
from .bind import CHUNKS, LISTING, MEM, STEPS
from .sizing import bounded_join

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BY = ["chain_key", "seq"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _shown(df: DataFrame, *more) -> DataFrame:
    return df.select(bind.chain_text().alias("chain_id"), "seq", *more)


def _path(c: str = "path"):
    return F.decode(c, "UTF-8").alias(c)


@query(f"WITH {LISTING} SELECT chain_id, seq, decode(path) AS path, entry_id, file_kind, size FROM listing")
def file_listing(spark, d):
    return _shown(bind.listing(spark, d), _path(), "entry_id", "file_kind", "size")


@query(f"WITH {LISTING}, x AS (SELECT chain_id, seq, decode(path) AS p FROM listing) SELECT chain_id, seq, p AS path, CASE WHEN p LIKE '%/%' THEN substr(p, 1, length(p) - position('/' IN reverse(p))) ELSE '' END AS parent, length(p) - length(replace(p, '/', '')) AS depth FROM x")
def path_parts(spark, d):
    rows = bind.listing(spark, d)
    return _shown(rows, _path(), F.decode(fl.parent_of(F.col("path")), "UTF-8").alias("parent"), fl.depth_of(F.col("path")).alias("depth"))


@query(f"""WITH {LISTING} SELECT l.chain_id, l.seq, decode(l.path) AS path FROM listing l WHERE octet_length(l.parent_path) > 0 AND NOT EXISTS (SELECT 1 FROM listing p WHERE p.chain_id = l.chain_id AND p.seq = l.seq AND p.path = l.parent_path AND p.file_kind = 2)""")
def orphan_paths(spark, d):
    return _shown(fl.orphan_paths(bind.listing(spark, d), BY), _path())


@query(f"""WITH {LISTING}, t AS (SELECT chain_id, seq, hardlink_group, min(path) AS target FROM listing WHERE file_kind = 1 AND hardlink_group > 0 GROUP BY 1, 2, 3)
SELECT l.chain_id, l.seq, decode(l.path) AS path, decode(target) AS target FROM listing l LEFT JOIN t USING (chain_id, seq, hardlink_group) WHERE file_kind = 4 AND hardlink_group > 0""")
def hardlink_groups(spark, d):
    return _shown(fl.hardlink_targets(bind.listing(spark, d), BY), _path(), _path("target"))


@query(f"WITH {LISTING} SELECT chain_id, seq, hardlink_group, count(*) AS n_links FROM listing WHERE hardlink_group > 0 GROUP BY 1, 2, 3")
def link_counts(spark, d):
    return _shown(fl.link_counts(bind.listing(spark, d), BY), "hardlink_group", "n_links")


@query(f"""WITH {LISTING}, w AS (SELECT chain_id, seq, path, min(path) OVER (PARTITION BY chain_id, seq, uid, gid, mtime_sec) AS f FROM listing WHERE file_kind = 1)
SELECT chain_id, seq, decode(path) AS path, path = f AS is_first, dense_rank() OVER (PARTITION BY chain_id, seq ORDER BY f) AS link_group FROM w""")
def inode_groups(spark, d):
    rows = fl.group_links(bind.listing(spark, d).where("file_kind = 1"), BY, ["uid", "gid", "mtime_sec"], "path")
    return _shown(rows, _path(), "is_first", "link_group")


_SAME = " AND ".join(f"n.{c} IS NOT DISTINCT FROM o.{c}" if c != "xattrs" else "list_sort(n.xattrs) IS NOT DISTINCT FROM list_sort(o.xattrs)" for c in fl.COMPARED)


def _with_xattrs(spark, d):
    """The listing with each entry's extended attributes in order of their names."""
    return bind.listing(spark, d, ("xattrs",)).withColumn("xattrs", F.array_sort("xattrs"))


def _steps(now: DataFrame) -> DataFrame:
    """Snapshots present: their chain, seq, the one before (null for the first) and the first. Some never came, so the one before isn't seq - 1."""
    line = Window.partitionBy("chain_key").orderBy("seq")
    return now.select(*BY).distinct().select(*BY, F.lag("seq").over(line).alias("prev_seq"), F.min("seq").over(Window.partitionBy("chain_key")).alias("first_seq"))


@query(f"""WITH {LISTING}, {STEPS} SELECT n.chain_id, n.seq, decode(n.path) AS path, n.file_kind, n.size, CASE WHEN o.path IS NULL THEN 'new' WHEN {_SAME} THEN 'unchanged' ELSE 'changed' END AS status
FROM listing n JOIN steps s ON s.chain_id = n.chain_id AND s.seq = n.seq AND s.prev_seq IS NOT NULL LEFT JOIN listing o ON o.chain_id = n.chain_id AND o.seq = s.prev_seq AND o.path = n.path""")
def file_incremental(spark, d):
    """Each entry against the listing of the newest snapshot before its own that is present."""
    now = cut(_with_xattrs(spark, d), "listing")
    later = cut(_steps(now).where("prev_seq is not null"), "steps")
    reference = bounded_join(now, later.select("chain_key", F.col("prev_seq").alias("seq"), F.col("seq").alias("next_seq")), BY).drop("seq").withColumnRenamed("next_seq", "seq")
    rows = fl.incremental(bounded_join(now, later.select(*BY), BY), reference, ["path"], BY)
    return _shown(rows, _path(), "file_kind", "size", "status")


@query(f"""WITH {LISTING}, {STEPS} SELECT n.chain_id, n.seq, CASE WHEN o.path IS NULL THEN 'new' WHEN {_SAME} THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS n_files, sum(n.size) AS bytes
FROM listing n JOIN steps s ON s.chain_id = n.chain_id AND s.seq = n.seq AND s.prev_seq IS NOT NULL LEFT JOIN listing o ON o.chain_id = n.chain_id AND o.seq = s.first_seq AND o.path = n.path GROUP BY 1, 2, 3""")
def file_differential(spark, d):
    """Each later snapshot against the first one present of its chain."""
    now = cut(_with_xattrs(spark, d), "listing")
    steps = cut(_steps(now), "steps")
    first = bounded_join(now, steps.where("seq = first_seq").select(*BY), BY)
    rows = fl.incremental(bounded_join(now, steps.where("prev_seq is not null").select(*BY), BY), first, ["path"], ["chain_key"], keep=["seq"])
    return _shown(rows.groupBy(*BY, "status").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes")), "status", "n_files", "bytes")


@query(f"""WITH {LISTING} SELECT chain_id, seq, decode(path) AS path, row_number() OVER (PARTITION BY chain_id, seq ORDER BY CASE file_kind WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 4 THEN 3 ELSE 2 END, path) AS position FROM listing""")
def restore_order(spark, d):
    return _shown(fl.restore_order(bind.listing(spark, d), BY), _path(), "position")


@query(f"""WITH {LISTING} SELECT chain_id, seq, decode(path) AS path, row_number() OVER (PARTITION BY chain_id, seq ORDER BY length(decode(path)) - length(replace(decode(path), '/', '')) DESC, path DESC) AS position FROM listing""")
def deepest_first(spark, d):
    return _shown(fl.deepest_first(bind.listing(spark, d), BY), _path(), "position")


@query(f"""WITH {LISTING}, k AS (SELECT chain_id, seq, parent_path AS dir, 2 AS r, path AS name FROM listing WHERE octet_length(path) > 0), a AS (SELECT * FROM k UNION ALL SELECT DISTINCT chain_id, seq, dir, 0, '.'::BLOB FROM k UNION ALL SELECT DISTINCT chain_id, seq, dir, 1, '..'::BLOB FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY chain_id, seq, dir ORDER BY r, name) - 1 AS place FROM a) SELECT chain_id, seq, decode(dir) AS dir, decode(name) AS name, place FROM n WHERE place >= 1 AND place < 5""")
def directory_page(spark, d):
    return _shown(fl.directory_page(bind.listing(spark, d), BY, 1, 4), _path("dir"), _path("name"), "place")


@query(f"""WITH {LISTING} SELECT chain_id, seq, count(*) FILTER (file_kind = 1) AS n_regular, count(*) FILTER (file_kind = 2) AS n_directory, count(*) FILTER (file_kind = 3) AS n_symlink, count(*) FILTER (file_kind = 4) AS n_hardlink, count(*) FILTER (file_kind = 5) AS n_special, sum(size) FILTER (file_kind = 1) AS bytes FROM listing GROUP BY 1, 2""")
def file_kind_counts(spark, d):
    return _shown(fl.kind_counts(bind.listing(spark, d), BY), "n_regular", "n_directory", "n_symlink", "n_hardlink", "n_special", "bytes")


_HOLES = """h AS (SELECT entry_id, delivered_unix, size, unnest(holes) AS hole, generate_subscripts(holes, 1) - 1 AS pos FROM file_entries WHERE holes IS NOT NULL),
e AS (SELECT DISTINCT entry_id, delivered_unix, size, pos, hole.hole_offset AS o, hole.hole_len AS n FROM h)"""


def _holed(spark, d):
    return table(spark, d, "file_entries").where("holes is not null").select("entry_id", "delivered_unix", "size", "holes").distinct()


@query(f"""WITH {_HOLES}, p AS (SELECT *, lag(o + n) OVER (PARTITION BY entry_id, delivered_unix, size ORDER BY pos) AS prev FROM e),
v AS (SELECT entry_id, delivered_unix, pos, CASE WHEN n <= 0 THEN 'empty' WHEN o < coalesce(prev, 0) THEN 'order' WHEN o + n > size THEN 'beyond_end' END AS check_id FROM p) SELECT * FROM v WHERE check_id IS NOT NULL""")
def hole_violations(spark, d):
    rows = _holed(spark, d).withColumn("s2", F.col("size"))
    return rg.hole_violations(rows, ["entry_id", "delivered_unix", "s2"], "holes", "hole_offset", "hole_len", "size").drop("s2")


@query(f"""WITH {_HOLES}, s AS (SELECT entry_id, delivered_unix, size, sum(n) AS holes FROM e GROUP BY 1, 2, 3) SELECT entry_id, delivered_unix, CAST(size - holes AS BIGINT) AS data_bytes FROM s WHERE size > 0 AND size > holes""")
def data_bytes_without_holes(spark, d):
    spans = rg.data_ranges(_holed(spark, d).where("size(holes) > 0"), ["entry_id", "delivered_unix"], "holes", "hole_offset", "hole_len", "size")
    return spans.groupBy("entry_id", "delivered_unix").agg(F.sum(F.col("end_incl") - F.col("start") + 1).alias("data_bytes"))


@query(f"""WITH {CHUNKS}, w AS (SELECT chunk_id, row_number() OVER (PARTITION BY chain_id, sha256(payload) ORDER BY batch_no, chunk_id) = 1 AS is_first FROM ck WHERE payload IS NOT NULL) SELECT chunk_id, is_first FROM w""")
def dedup_first_occurrence(spark, d):
    rows = bind.chunks(spark, d).where("payload is not null").select("chain_id", "chunk_id", "batch_no", F.sha2("payload", 256).alias("digest"))
    return fl.first_occurrence(rows, ["chain_id"], ["digest"], ["batch_no", "chunk_id"]).select("chunk_id", "is_first")


@query(f"""WITH {CHUNKS}, g AS (SELECT chain_id, sha256(payload) AS h, count(*) AS n, sum(plain_len) AS b, max(plain_len) AS u FROM ck GROUP BY 1, 2) SELECT chain_id, CAST(sum(n) AS BIGINT) AS n_chunks, count(*) AS n_unique, CAST(sum(b) AS BIGINT) AS logical_bytes, CAST(sum(u) AS BIGINT) AS unique_bytes FROM g GROUP BY 1""")
def dedup_ratio(spark, d):
    return fl.dedup_summary(bind.chunks(spark, d).withColumn("digest", F.sha2("payload", 256)), ["chain_id"], ["digest"], "plain_len")


@query(f"""WITH {CHUNKS} SELECT chain_id, lower(hash) AS hash, max(member_seq) AS member_seq, max_by(chunk_id, (member_seq, chunk_id)) AS chunk_id FROM ck WHERE hash IS NOT NULL GROUP BY 1, 2""")
def reference_resolution(spark, d):
    rows = bind.chunks(spark, d).where("hash is not null").withColumn("hash", F.lower("hash"))
    return fl.owners(rows, ["chain_id", "hash"], "member_seq", ["chunk_id"])


@query(f"""WITH {CHUNKS} SELECT chunk_id FROM ck c WHERE payload IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ck i WHERE i.chain_id = c.chain_id AND i.hash IS NOT NULL AND lower(i.hash) = sha256(c.payload))""")
def dangling_refs(spark, d):
    rows = bind.chunks(spark, d)
    index = rows.where("hash is not null").select("chain_id", F.lower("hash").alias("ref"))
    return fl.dangling(rows.where("payload is not null").select("chunk_id", "chain_id", F.sha2("payload", 256).alias("ref")), index, ["chain_id", "ref"]).select("chunk_id")


@query(f"""WITH {CHUNKS} SELECT chunk_id, coalesce(sum(plain_len) OVER (PARTITION BY chain_id, member_seq ORDER BY batch_no, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS file_offset FROM ck""")
def running_offsets(spark, d):
    return fl.running_offsets(bind.chunks(spark, d), ["chain_id", "member_seq"], ["batch_no", "chunk_id"], "plain_len").select("chunk_id", "file_offset")


@query("""WITH r AS (SELECT split_part(reason, ' ', 1) AS kind, reason AS what, count(*) AS n FROM retired_members WHERE reason IS NOT NULL GROUP BY 1, 2), t AS (SELECT kind, what, row_number() OVER (PARTITION BY kind ORDER BY what) AS k FROM r)
SELECT r.kind, CAST(sum(n) AS BIGINT) AS n_losses, (SELECT string_agg(what, '|' ORDER BY what) FROM t WHERE t.kind = r.kind AND k <= 3) AS examples FROM r GROUP BY 1""")
def loss_summary(spark, d):
    s = fl.loss_summary(table(spark, d, "retired_members"), "reason")
    return s.select("kind", "n_losses", F.array_join("examples", "|").alias("examples"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substr(text, CAST(i * 512 + 1 AS BIGINT), 512) AS piece FROM (SELECT doc_id, text, unnest(range((length(text) + 511) // 512)) AS i FROM documents WHERE length(text) > 0)")
def fixed_chunks(spark, d):
    return ck.fixed_chunks(table(spark, d, "documents"), ["doc_id"], "text", 512)


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE length(text) > 0")
def chunk_reassembly(spark, d):
    pieces = ck.fixed_chunks(table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body")), ["doc_id"], "body", 700)
    return ck.reassemble(pieces, ["doc_id"], "chunk_no", "piece").select("doc_id", F.sha2("content", 256).alias("digest"))


@query("SELECT chunk_id, substr(hex(payload) || repeat('0', 600), 201, 200) AS content FROM chunks WHERE octet_length(payload) > 0")
def range_read(spark, d):
    pieces = ck.fixed_chunks(table(spark, d, "chunks").select("chunk_id", "payload"), ["chunk_id"], "payload", 64)
    return ck.read_range(pieces, ["chunk_id"], "chunk_no", "piece", 64, 100, 100).select("chunk_id", F.hex("content").alias("content"))


@query("SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) AS n_bytes FROM documents WHERE length(text) > 0")
def cdc_reassembly(spark, d):
    pieces = ck.cdc_chunks(table(spark, d, "documents"), ["doc_id"], "text", 256, 1024, 4096)
    whole = ck.reassemble(pieces, ["doc_id"], "chunk_no", "piece")
    return whole.select("doc_id", F.sha2("content", 256).alias("digest"), F.length("content").alias("n_bytes"))


@query()
def cdc_chunks(spark, d):
    return ck.cdc_chunks(table(spark, d, "documents"), ["doc_id"], "text", 256, 1024, 4096).select("doc_id", "chunk_no", "chunk_offset", F.length("piece").alias("n_bytes"), F.sha2("piece", 256).alias("digest"))


@query("SELECT count(*) AS n_texts, count(*) AS n_equal FROM documents WHERE length(text) > 0")
def zstd_round_trip(spark, d):
    t = table(spark, d, "documents").where("length(text) > 0").select(F.encode("text", "UTF-8").alias("body"))
    z = t.withColumn("packed", ck.compress_if_smaller("body"))
    back = F.coalesce(ck.decompress("packed"), F.col("body"))
    return z.agg(F.count("*").alias("n_texts"), F.count(F.when((back == F.col("body")) & (F.coalesce(F.length("packed"), F.lit(0)) < F.length("body")), 1)).alias("n_equal"))


@query("SELECT chunk_id, sha256(payload) AS digest FROM chunks WHERE payload IS NOT NULL")
def aead_round_trip(spark, d):
    key, aad = F.lit(b"0123456789abcdef0123456789abcdef"), F.encode("hash", "UTF-8")
    rows = table(spark, d, "chunks").where("payload is not null").withColumn("hash", F.coalesce("hash", F.lit("")))
    sealed = rows.withColumn("sealed", ck.seal(F.col("payload"), key, ck.nonce(F.col("chunk_id")), aad))
    return sealed.select("chunk_id", F.sha2(ck.unseal(F.col("sealed"), key, aad), 256).alias("digest"))


@query("SELECT chunk_id, sha256('key'::BLOB || payload) AS digest FROM chunks WHERE payload IS NOT NULL")
def keyed_hash(spark, d):
    return table(spark, d, "chunks").where("payload is not null").select("chunk_id", tx.keyed_hash("key", F.col("payload")).alias("digest"))


@query("SELECT chunk_id, replace(hex(payload), '0', '') = '' AS is_zero FROM chunks WHERE payload IS NOT NULL")
def zero_chunks(spark, d):
    return table(spark, d, "chunks").where("payload is not null").select("chunk_id", tx.is_zero(F.col("payload")).alias("is_zero"))


@query(f"""WITH {MEM} SELECT image_uuid, CASE WHEN size_bytes >= 1099511627776 THEN printf('%.1f TiB', size_bytes / 1099511627776) WHEN size_bytes >= 1073741824 THEN printf('%.1f GiB', size_bytes / 1073741824) WHEN size_bytes >= 1048576 THEN printf('%.1f MiB', size_bytes / 1048576)
WHEN size_bytes >= 1024 THEN printf('%.1f KiB', size_bytes / 1024) ELSE size_bytes || ' B' END AS size FROM mem""")
def human_size(spark, d):
    return bind.members(spark, d).select("image_uuid", tx.human_size(F.col("size_bytes")).alias("size"))


@query("""WITH t AS (SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN n_nationkey || 'KiB' WHEN 1 THEN n_nationkey || ' MiB' WHEN 2 THEN n_nationkey || '' WHEN 3 THEN n_nationkey || 'GB' ELSE '99999999TiB' END AS text FROM nation)
SELECT k, CASE WHEN k % 5 = 0 THEN k * 1024 WHEN k % 5 = 1 THEN k * 1048576 WHEN k % 5 = 2 THEN k END AS n_bytes FROM t""")
def parse_size(spark, d):
    k = F.col("n_nationkey")
    text = F.when(k % 5 == 0, F.concat(k, F.lit("KiB"))).when(k % 5 == 1, F.concat(k, F.lit(" MiB"))).when(k % 5 == 2, k.cast("string")).when(k % 5 == 3, F.concat(k, F.lit("GB"))).otherwise("99999999TiB")
    return table(spark, d, "nation").select(k.alias("k"), tx.parse_size(text).alias("n_bytes"))


@query(f"""WITH {MEM} SELECT image_uuid, file_name, coalesce(regexp_matches(file_name, '^[A-Za-z0-9][A-Za-z0-9._-]{{0,63}}$'), false) AS is_valid FROM mem""")
def valid_names(spark, d):
    return bind.members(spark, d).select("image_uuid", "file_name", tx.valid_name(F.col("file_name")).alias("is_valid"))


@query(f"WITH {MEM} SELECT image_uuid, coalesce(chunk_size BETWEEN 262144 AND 4194304 AND chunk_size & (chunk_size - 1) = 0, false) AS is_valid FROM mem")
def valid_chunk_sizes(spark, d):
    return bind.members(spark, d).select("image_uuid", F.coalesce(tx.valid_chunk_size(F.col("chunk_size")), F.lit(False)).alias("is_valid"))


@query("SELECT set_id, CASE WHEN len(p) >= 4 THEN array_to_string(p[:-4], '/') END AS place, CASE WHEN len(p) >= 4 THEN p[-3] END AS set_part, CASE WHEN len(p) >= 4 THEN p[-2] || '/' || p[-1] END AS file_part FROM (SELECT set_id, string_split(destination, '/') AS p FROM backup_sets)")
def split_image(spark, d):
    a, b, c = tx.split_image(F.col("destination"))
    return table(spark, d, "backup_sets").select("set_id", a.alias("place"), b.alias("set_part"), c.alias("file_part"))


@query(f"WITH {MEM} SELECT image_uuid, CASE WHEN created_unix BETWEEN 0 AND 253402300799 THEN strftime(make_timestamp(created_unix * 1000000), '%Y-%m-%d %H:%M UTC') ELSE 'unknown' END AS created FROM mem")
def created_at(spark, d):
    return bind.members(spark, d).select("image_uuid", tx.created_at(F.col("created_unix")).alias("created"))


@query("SELECT event_id, (CAST(user_id AS BIGINT) << 20) | (event_id % 256) AS dev FROM events")
def device_numbers(spark, d):
    return table(spark, d, "events").select("event_id", tx.dev_number(F.col("user_id"), F.col("event_id") % 256).alias("dev"))


@query("SELECT n_nationkey AS k, 6 AS major, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE n_nationkey END AS minor FROM nation")
def kernel_versions(spark, d):
    k = F.col("n_nationkey")
    a, b = tx.kernel_version(F.when(k % 3 == 0, F.lit("6-rc1")).otherwise(F.concat(F.lit("6."), k, F.lit(".1-amd64+x"))))
    return table(spark, d, "nation").select(k.alias("k"), a.alias("major"), b.alias("minor"))


@query("SELECT n_nationkey AS k, u.i AS pos, CAST(u.i * 10 AS BIGINT) AS start, CAST(CASE WHEN u.i % 2 = 0 THEN u.i * 10 ELSE u.i * 10 + n_nationkey END AS BIGINT) AS end_incl FROM nation, LATERAL (SELECT unnest(range(n_nationkey % 4 + 1)) AS i) u")
def parse_ranges(spark, d):
    k = F.col("n_nationkey")
    one = F.transform(F.sequence(F.lit(0), k % 4), lambda i: F.when(i % 2 == 0, (i * 10).cast("string")).otherwise(F.concat(i * 10, F.lit("-"), i * 10 + k)))
    rows = table(spark, d, "nation").select(k.alias("k"), F.posexplode(tx.parse_ranges(F.array_join(one, ", "))).alias("pos", "r"))
    return rows.select("k", F.col("pos").cast("bigint").alias("pos"), "r.start", "r.end_incl")


@query(f"WITH {LISTING}, x AS (SELECT DISTINCT decode(path) AS path FROM listing), y AS (SELECT path, regexp_replace(regexp_replace(path, '^/+', ''), '/+$', '') AS b FROM x) SELECT path, CASE WHEN b = '' THEN 'FS_TREE' ELSE replace(replace(b, '%', '%25'), '/', '%2F') END AS escaped FROM y")
def subvolume_escape(spark, d):
    return bind.listing(spark, d).select(_path()).distinct().select("path", tx.escape_subvolume(F.col("path")).alias("escaped"))


@query(f"WITH {LISTING}, x AS (SELECT DISTINCT decode(path) AS path FROM listing) SELECT path, path = '' OR NOT list_has_any(string_split(path, '/'), ['', '.', '..']) AS is_plain FROM x")
def plain_paths(spark, d):
    return bind.listing(spark, d).select(_path()).distinct().select("path", tx.plain_path(F.col("path")).alias("is_plain"))


@query("SELECT event_id, CASE WHEN get_k IS NULL THEN NULL ELSE get_k END AS target FROM (SELECT event_id, json_extract_string(props, '$.k') AS get_k FROM events)")
def report_fields(spark, d):
    return table(spark, d, "events").select("event_id", tx.summary_target(F.replace("props", F.lit('"k"'), F.lit('"target"'))).alias("target"))


_TRACE = "t AS (SELECT event_id, user_id % 7 AS ma, event_id % 5 AS mi, event_id % 4 AS kind, event_id * 8 AS sector, event_id % 3 * 8 AS sectors FROM events)"


@query(f"""WITH {_TRACE} SELECT event_id, CASE WHEN kind = 1 THEN 'complete' ELSE 'queue' END AS phase, CASE WHEN kind = 2 THEN NULL ELSE CAST(ma AS INTEGER) END AS major, CASE WHEN kind = 2 THEN NULL WHEN sectors = 0 THEN 0 ELSE sector END AS sector, CASE WHEN kind = 2 THEN NULL ELSE sectors END AS sectors, kind = 2 AS malformed,
CASE WHEN kind = 2 THEN NULL WHEN sectors = 0 THEN 'none' WHEN kind = 0 THEN 'read' ELSE 'dirty' END AS io FROM t WHERE kind <> 3""")
def parse_trace(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 7).alias("ma"), (F.col("event_id") % 5).alias("mi"), (F.col("event_id") % 4).alias("kind"), (F.col("event_id") * 8).alias("sector"), (F.col("event_id") % 3 * 8).alias("sectors"))
    dev = F.concat_ws(",", "ma", "mi")
    line = F.when(F.col("kind") == 0, F.concat(F.lit("dd-1 [0] .. 1.0: block_bio_queue: "), dev, F.lit(" FR "), "sector", F.lit(" + "), "sectors", F.lit(" [dd]"))).when(F.col("kind") == 1, F.concat(F.lit("kw-2 [1] .. 1.0: block_rq_complete: "), dev, F.lit(" WS () "), F.when(F.col("sectors") == 0, F.lit("18446744073709551615")).otherwise(F.col("sector").cast("string")), F.lit(" + "), "sectors", F.lit(" none,0,0 [0]"))).when(F.col("kind") == 2, F.lit("x: block_bio_queue: nonsense")).otherwise(F.lit("some other line"))
    rows = e.select("event_id", tx.trace_event(line).alias("e")).where("e is not null").select("event_id", "e.*")
    io = F.when(~F.col("malformed"), tx.io_class(F.col("flags"), F.col("sectors")))
    return rows.select("event_id", "phase", "major", "sector", "sectors", "malformed", io.alias("io"))


@query("SELECT 'chain' AS file, n_nationkey AS mount_id, '8:' || n_nationkey AS dev, '/' AS root, '/mnt/' || n_name || ' x' AS mount_point, 'ext4' AS fs_type, '/dev/sd' || n_nationkey AS source FROM nation")
def parse_mountinfo(spark, d):
    line = F.concat("n_nationkey", F.lit(" 1 8:"), "n_nationkey", F.lit(" / /mnt/"), "n_name", F.lit("\\040x rw,relatime shared:1 - ext4 /dev/sd"), "n_nationkey", F.lit(" rw"))
    return parsers.mountinfo(table(spark, d, "nation").select(F.lit("chain").alias("file"), F.lit(0).alias("line_no"), F.explode(F.array(line, F.lit("short line"))).alias("line")))


@query("SELECT destination AS uri, to_json({'mode': 'set', 'set_id': set_id, 'keep_chains': keep_chains}) AS report FROM backup_sets")
def set_reports(spark, d):
    b = table(spark, d, "backup_sets")
    return b.select(F.col("destination").alias("uri"), F.to_json(F.struct(F.lit("set").alias("mode"), "set_id", "keep_chains")).alias("report"))
