"""Queries p1, p4 and p5 over the backup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import canonical_id, hyphenate, id_hex, id_or_null
from ..operators.hierarchy import ancestors, hierarchy
from ..operators.orphans import orphan_references, orphan_report
from ..operators.snapshots import snapshot_changes, snapshot_intervals
from ..sources import table

ENTRY_VALUES = ["mtime_sec", "size", "mode"]


def _listings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_entries").withColumn("chain_key", F.unhex(id_hex("chain_id")))


def _chain_text(c: str):
    return hyphenate(F.lower(F.hex(c)))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Paths added, removed or changed from each snapshot of a chain to the next one present."""
    events = snapshot_changes(_listings(spark, d), group="chain_key", seq="seq", key="path", values=ENTRY_VALUES, version="delivered_unix")
    return events.select(_chain_text("grp").alias("chain_id"), "seq", F.decode("key", "UTF-8").alias("path"), "change_kind")


def p1_intervals(spark: SparkSession, d: str) -> DataFrame:
    """From which to which snapshot each version of a path was valid."""
    spans = snapshot_intervals(_listings(spark, d), group="chain_key", seq="seq", key="path", values=ENTRY_VALUES, version="delivered_unix")
    return spans.select(_chain_text("grp").alias("chain_id"), F.decode("key", "UTF-8").alias("path"), "first_seq", "next_seq", (F.col("last_pos") - F.col("first_pos") + 1).cast("bigint").alias("n_snapshots"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references of members and hard links."""
    m = table(spark, d, "members").groupBy(canonical_id("image_uuid").alias("image")).agg(F.max(id_or_null("parent_uuid")).alias("parent"), F.min("scanned_unix").alias("arrival"))
    retired = table(spark, d, "retired_members").groupBy(canonical_id("image_uuid").alias("image")).agg(F.min("retired_unix").alias("retired"))
    m_refs = m.where(F.col("parent").isNotNull()).select(F.lit("members").alias("ref_table"), F.col("image").alias("ref_key"), F.col("parent").alias("target"), "arrival")
    m_parents = m.join(retired, "image", "left").select(F.lit("members").alias("ref_table"), F.col("image").alias("target"), "arrival", "retired")
    e = table(spark, d, "file_entries").where((F.col("hardlink_group") > 0) & F.col("file_kind").isin(1, 4))
    name = F.concat_ws("|", id_hex("chain_id"), F.col("seq"), F.col("hardlink_group"))
    e = e.groupBy("entry_id", "file_kind").agg(F.max(name).alias("target"), F.min("delivered_unix").alias("arrival"))
    f_refs = e.where("file_kind = 4").select(F.lit("file_entries").alias("ref_table"), F.col("entry_id").cast("string").alias("ref_key"), "target", "arrival")
    f_parents = e.where("file_kind = 1").select(F.lit("file_entries").alias("ref_table"), "target", "arrival", F.lit(None).cast("bigint").alias("retired"))
    return orphan_references(m_refs.unionByName(f_refs), m_parents.unionByName(f_parents))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p4_found(spark, d))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "members").select(canonical_id("image_uuid").alias("image_uuid"), id_or_null("parent_uuid").alias("parent_uuid"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every image; 'cycle' and -1 where the line never ends."""
    h = hierarchy(_lines(spark, d), node="image_uuid", parent="parent_uuid", with_path=False)
    return h.select(F.col("node").alias("image_uuid"), F.coalesce("root", F.lit("cycle")).alias("root_uuid"), F.col("depth").cast("int").alias("depth"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path from the root and number of descendants."""
    h = hierarchy(_lines(spark, d), node="image_uuid", parent="parent_uuid")
    return h.select(F.col("node").alias("image_uuid"), "path", F.col("depth").cast("int").alias("depth"), "n_descendants")


def p5_cycles(spark: SparkSession, d: str) -> DataFrame:
    """One row per cycle: the image whose parent link closes it, and that parent's end of the walk."""
    h = hierarchy(_lines(spark, d), node="image_uuid", parent="parent_uuid", with_path=False)
    return h.where("back_edge_from is not null").select(F.col("node").alias("image_uuid"), "back_edge_from")


def p5_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Each image's place in the depth-first walk of its tree and that of its last descendant: all descendants in a row."""
    h = hierarchy(_lines(spark, d), node="image_uuid", parent="parent_uuid", with_path=False).where("depth >= 0")
    return h.select(F.col("node").alias("image_uuid"), F.col("root").alias("root_uuid"), F.col("entry").alias("first_entry"), (F.col("entry") + F.col("n_descendants")).alias("last_entry"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every (ancestor, descendant) pair of images whose lines end, with the distance."""
    h = hierarchy(_lines(spark, d), node="image_uuid", parent="parent_uuid", with_path=False).where(F.col("depth") >= 0).select(F.col("node").alias("image_uuid"))
    links = _lines(spark, d).groupBy("image_uuid").agg(F.min("parent_uuid").alias("parent_uuid")).join(h, "image_uuid")
    known = h.select(F.col("image_uuid").alias("parent_uuid"), F.lit(True).alias("known"))
    trees = links.join(known, "parent_uuid", "left").select(F.col("image_uuid").alias("node"), F.when(F.col("known"), F.col("parent_uuid")).alias("parent"))
    return ancestors(trees).select(F.col("ancestor").alias("ancestor_uuid"), F.col("node").alias("image_uuid"), F.col("distance").cast("int").alias("distance"))


QUERIES = {f.__name__: f for f in (p1_found, p1_intervals, p4_found, p4_report, p5_found, p5_paths, p5_cycles, p5_intervals, p5_descendants)}

def _hex(c: str) -> str:
    return f"replace(replace(replace(replace(lower(trim({c})), 'urn:uuid:', ''), '-', ''), '{{', ''), '}}', '')"


def _canon(c: str) -> str:
    h = _hex(c)
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12))"


_NONE = "00000000-0000-0000-0000-000000000000"
_P1 = f"""
WITH r AS (SELECT chain_id, seq, path, mtime_sec, size, mode FROM (
  SELECT {_canon('chain_id')} AS chain_id, seq, path, mtime_sec, size, mode,
         row_number() OVER (PARTITION BY {_canon('chain_id')}, seq, path ORDER BY delivered_unix DESC NULLS LAST, mtime_sec, size, mode) AS rn
  FROM file_entries) WHERE rn = 1),
s AS (SELECT chain_id, seq, row_number() OVER (PARTITION BY chain_id ORDER BY seq) AS pos,
             lead(seq) OVER (PARTITION BY chain_id ORDER BY seq) AS next_seq
      FROM (SELECT DISTINCT chain_id, seq FROM r))
"""
_LINKS = f"""l AS (SELECT {_canon('image_uuid')} AS image_uuid, min(nullif({_canon('parent_uuid')}, '{_NONE}')) AS parent_uuid FROM members GROUP BY 1),
t AS (SELECT l.image_uuid, p.image_uuid AS parent_uuid FROM l LEFT JOIN l p ON l.parent_uuid = p.image_uuid)"""
_WALK = f"""WITH RECURSIVE {_LINKS},
w AS (SELECT image_uuid, image_uuid AS root_uuid, 0 AS depth, image_uuid AS path FROM t WHERE parent_uuid IS NULL
      UNION ALL SELECT t.image_uuid, w.root_uuid, w.depth + 1, w.path || '/' || t.image_uuid FROM w JOIN t ON t.parent_uuid = w.image_uuid)"""
_P4 = f"""
WITH m AS (SELECT {_canon('image_uuid')} AS image, max(nullif({_canon('parent_uuid')}, '{_NONE}')) AS parent, min(scanned_unix) AS arrival FROM members GROUP BY 1),
d AS (SELECT {_canon('image_uuid')} AS image, min(retired_unix) AS retired FROM retired_members GROUP BY 1),
e AS (SELECT entry_id, file_kind, {_hex('chain_id')} AS chain, seq, hardlink_group, min(delivered_unix) AS arrival FROM file_entries WHERE hardlink_group > 0 AND file_kind IN (1, 4) GROUP BY ALL),
g AS (SELECT chain, seq, hardlink_group, min(arrival) AS arrival FROM e WHERE file_kind = 1 GROUP BY ALL),
o AS (SELECT 'members' AS ref_table, m.image AS ref_key, m.arrival,
        CASE WHEN p.image IS NULL THEN 'missing' WHEN p.arrival > m.arrival THEN 'late' WHEN d.retired <= m.arrival THEN 'deleted' END AS reason
      FROM m LEFT JOIN m p ON m.parent = p.image LEFT JOIN d ON d.image = m.parent WHERE m.parent IS NOT NULL
      UNION ALL
      SELECT 'file_entries', CAST(e.entry_id AS VARCHAR), e.arrival, CASE WHEN g.chain IS NULL THEN 'missing' WHEN g.arrival > e.arrival THEN 'late' END
      FROM e LEFT JOIN g USING (chain, seq, hardlink_group) WHERE e.file_kind = 4),
f AS (SELECT ref_table, ref_key, reason, CAST(floor(arrival / 604800) AS BIGINT) AS period_week FROM o WHERE reason IS NOT NULL)
"""
SQL = {
    "p1_found": _P1 + """, j AS (SELECT r.*, s.pos, s.next_seq, lag(s.pos) OVER w AS before, lead(s.pos) OVER w AS after,
  lag(mtime_sec) OVER w AS m0, lag(size) OVER w AS s0, lag(mode) OVER w AS o0 FROM r JOIN s USING (chain_id, seq) WINDOW w AS (PARTITION BY chain_id, path ORDER BY s.pos))
SELECT chain_id, seq, decode(path) AS path, 'added' AS change_kind FROM j WHERE pos > 1 AND (before IS NULL OR before < pos - 1)
UNION ALL SELECT chain_id, next_seq, decode(path), 'removed' FROM j WHERE next_seq IS NOT NULL AND (after IS NULL OR after > pos + 1)
UNION ALL SELECT chain_id, seq, decode(path), 'changed' FROM j WHERE before = pos - 1 AND (mtime_sec IS DISTINCT FROM m0 OR size IS DISTINCT FROM s0 OR mode IS DISTINCT FROM o0)""",
    "p1_intervals": _P1 + """, j AS (SELECT r.*, s.pos, s.next_seq, CASE WHEN lag(s.pos) OVER w = s.pos - 1 AND mtime_sec IS NOT DISTINCT FROM lag(mtime_sec) OVER w AND size IS NOT DISTINCT FROM lag(size) OVER w AND mode IS NOT DISTINCT FROM lag(mode) OVER w THEN 0 ELSE 1 END AS starts
  FROM r JOIN s USING (chain_id, seq) WINDOW w AS (PARTITION BY chain_id, path ORDER BY s.pos)),
k AS (SELECT *, sum(starts) OVER (PARTITION BY chain_id, path ORDER BY pos) AS island FROM j)
SELECT chain_id, decode(path) AS path, min(seq) AS first_seq, CASE WHEN count(next_seq) = count(*) THEN max(next_seq) END AS next_seq, count(*) AS n_snapshots FROM k GROUP BY chain_id, path, island""",
    "p4_found": _P4 + "SELECT ref_table, ref_key, reason, period_week FROM f",
    "p4_report": _P4 + "SELECT ref_table, period_week, reason, count(*) AS n_refs FROM f GROUP BY ALL",
    "p5_found": _WALK + "\nSELECT t.image_uuid, coalesce(w.root_uuid, 'cycle') AS root_uuid, CAST(coalesce(w.depth, -1) AS INTEGER) AS depth FROM t LEFT JOIN w USING (image_uuid)",
    "p5_paths": _WALK + """,
u AS (SELECT image_uuid, parent_uuid AS up FROM t WHERE parent_uuid IS NOT NULL UNION ALL SELECT u.image_uuid, t.parent_uuid FROM u JOIN t ON t.image_uuid = u.up JOIN w ON w.image_uuid = u.image_uuid WHERE t.parent_uuid IS NOT NULL),
n AS (SELECT up, count(*) AS c FROM u JOIN w USING (image_uuid) GROUP BY 1)
SELECT t.image_uuid, w.path, CAST(coalesce(w.depth, -1) AS INTEGER) AS depth, CASE WHEN w.depth IS NULL THEN -1 ELSE coalesce(n.c, 0) END AS n_descendants FROM t LEFT JOIN w USING (image_uuid) LEFT JOIN n ON n.up = t.image_uuid""",
    "p5_descendants": f"""WITH RECURSIVE {_LINKS},
w AS (SELECT image_uuid, 0 AS depth FROM t WHERE parent_uuid IS NULL UNION ALL SELECT t.image_uuid, w.depth + 1 FROM w JOIN t ON t.parent_uuid = w.image_uuid),
u AS (SELECT t.image_uuid, t.parent_uuid AS ancestor_uuid, 1 AS distance FROM t JOIN w USING (image_uuid) WHERE t.parent_uuid IS NOT NULL
      UNION ALL SELECT u.image_uuid, t.parent_uuid, u.distance + 1 FROM u JOIN t ON t.image_uuid = u.ancestor_uuid WHERE t.parent_uuid IS NOT NULL)
SELECT ancestor_uuid, image_uuid, CAST(distance AS INTEGER) AS distance FROM u""",
    "p5_intervals": _WALK + """,
e AS (SELECT *, row_number() OVER (PARTITION BY root_uuid ORDER BY path) - 1 AS entry FROM w),
k AS (SELECT e.image_uuid, max(d.entry) AS last_entry FROM e JOIN e d ON d.root_uuid = e.root_uuid AND starts_with(d.path, e.path) GROUP BY 1)
SELECT image_uuid, root_uuid, entry AS first_entry, last_entry FROM e JOIN k USING (image_uuid)""",
    "p5_cycles": f"""WITH RECURSIVE {_LINKS},
u AS (SELECT image_uuid AS a, parent_uuid AS b FROM t WHERE parent_uuid IS NOT NULL UNION SELECT u.a, t.parent_uuid FROM u JOIN t ON t.image_uuid = u.b WHERE t.parent_uuid IS NOT NULL),
c AS (SELECT DISTINCT a FROM u WHERE a = b), m AS (SELECT u.a, min(u.b) AS low FROM u JOIN c ON u.a = c.a GROUP BY 1)
SELECT t.image_uuid, t.parent_uuid AS back_edge_from FROM t JOIN m ON m.a = t.image_uuid AND m.low = m.a""",
}
