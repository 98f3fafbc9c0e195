"""Queries p2, p3, p6, p7 and p8 over the backup tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import canonical_id, id_hex
from ..plans.sizing import bounded_join
from ..session import cut
from ..sources import table
from . import history, mixing, packing, seen
from . import spans as sp
from .tokens import token_counts

LEAST = 240


def _spans(spark: SparkSession, d: str) -> sp.SharedSpans:
    return sp.shared_spans(table(spark, d, "documents").select("doc_id", "text"), id_col="doc_id", text_col="text", least=LEAST)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents whose texts contain a common run of at least 240 characters."""
    return sp.shared_pairs(_spans(spark, d), LEAST)


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Per document its class of equal texts and the number of other classes that share a run with it."""
    return sp.shared_classes(_spans(spark, d), LEAST)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per document the share of its characters that also stand in another document."""
    return sp.shared_shares(_spans(spark, d), LEAST)


def _keys(spark: SparkSession, d: str) -> DataFrame:
    chunks = seen.keyed(table(spark, d, "chunks"), "chunks", record_id="chunk_id", order="batch_no", key=[F.col("payload")])
    plan = table(spark, d, "chunk_plan").withColumn("chain_key", id_hex("chain_id"))
    return chunks.unionByName(seen.keyed(plan, "chunk_plan", record_id="plan_id", order="received_unix", key=[F.col("chain_key"), F.col("region"), F.col("chunk_index")]))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of chunks and chunk_plan whose key is in an earlier row of their table."""
    return seen.seen_before(_keys(spark, d))


def p3_audit(spark: SparkSession, d: str) -> DataFrame:
    """The measured rate of wrong answers of the cuckoo tables, per stream."""
    return seen.audit(_keys(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunk records that repeat or nearly repeat one accepted before, within their backup set."""
    chains = cut(table(spark, d, "members").groupBy(canonical_id("chain_id").alias("chain")).agg(F.min(canonical_id("set_id")).alias("set_id")), "chains")
    chunks = table(spark, d, "chunks").where(F.col("payload").isNotNull()).select("chunk_id", "batch_no", canonical_id("chain_id").alias("chain"), "payload")
    records = bounded_join(chunks, chains, ["chain"], rows=200_000)
    pairs = history.repeats(records, group="set_id", batch="batch_no", record_id="chunk_id", payload="payload")
    return pairs.select(F.least("accepted", "repeated").alias("chunk_a"), F.greatest("accepted", "repeated").alias("chunk_b"))


def _specs(spark: SparkSession, d: str) -> list[tuple[int, int]]:
    return [(r["spec_id"], r["capacity_tokens"]) for r in table(spark, d, "pack_specs").orderBy("spec_id").collect()]  # fixed table of 3 rows


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The texts in each container of each capacity."""
    sizes = cut(token_counts(table(spark, d, "documents"), "text", ["doc_id"]), "sizes")
    return packing.pack(sizes, _specs(spark, d))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full each container is."""
    specs = table(spark, d, "pack_specs").select("spec_id", F.col("capacity_tokens").alias("capacity"))
    return packing.fills(p6_containers(spark, d), specs)


def _mixed(spark: SparkSession, d: str):
    targets = [(r["mix_id"], r["source"], r["target_share"], r["max_repeats"]) for r in table(spark, d, "mix_targets").withColumn("source", F.lower(F.trim("source"))).orderBy("mix_id", "source").collect()]  # fixed table of 17 rows
    docs = table(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"), "text").where(F.col("source").isin([t[1] for t in targets]))
    sizes = cut(token_counts(docs, "text", ["doc_id", "source"]), "sizes")
    return mixing.mix(sizes, targets)[0], targets


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The texts drawn for each mix, with repeats, in the order of the schedule."""
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source in each mix."""
    return mixing.shares(*_mixed(spark, d))


QUERIES = {f.__name__: f for f in (p6_containers, p6_fill, p7_mix, p7_shares, p2_found, p3_found, p3_audit, p8_found, p8_classes, p8_shares)}

_HEX = "replace(replace(replace(replace(lower(trim(chain_id)), 'urn:uuid:', ''), '-', ''), '{', ''), '}', '')"
SQL = {
    "p3_found": f"""SELECT 'chunks' AS stream_name, chunk_id AS record_id FROM (SELECT chunk_id, row_number() OVER (PARTITION BY payload ORDER BY batch_no, chunk_id) AS rn FROM chunks WHERE payload IS NOT NULL) WHERE rn > 1
UNION ALL SELECT 'chunk_plan', plan_id FROM (SELECT plan_id, row_number() OVER (PARTITION BY {_HEX}, region, chunk_index ORDER BY received_unix, plan_id) AS rn FROM chunk_plan WHERE chunk_index IS NOT NULL) WHERE rn > 1""",
}

# every run of 240 characters of every text, by content; texts that hold a run, and where
_RUNS = f"""docs AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, k, md5_number(substr(text, k, {LEAST})) AS h FROM (SELECT doc_id, text, unnest(range(1, n - {LEAST - 2})) AS k FROM docs WHERE n >= {LEAST})),
hd AS (SELECT DISTINCT h, doc_id FROM w), many AS (SELECT h FROM hd GROUP BY 1 HAVING count(*) > 1)"""
SQL["p8_found"] = f"WITH {_RUNS} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM hd a JOIN hd b ON a.h = b.h AND a.doc_id < b.doc_id"
SQL["p8_shares"] = f"""WITH {_RUNS}, s AS (SELECT doc_id, k, max(k + {LEAST}) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w SEMI JOIN many USING (h)),
c AS (SELECT doc_id, CAST(sum(k + {LEAST} - greatest(k, coalesce(reach, 0))) AS BIGINT) AS n FROM s GROUP BY 1)
SELECT d.doc_id, d.n AS n_chars, coalesce(c.n, 0) AS n_shared, CASE WHEN d.n > 0 THEN round(coalesce(c.n, 0) / d.n, 6) ELSE 0.0 END AS share FROM docs d LEFT JOIN c USING (doc_id)"""
SQL["p8_classes"] = f"""WITH {_RUNS}, cl AS (SELECT text, min(doc_id) AS class_id, count(*) AS n_copies FROM docs GROUP BY 1), m AS (SELECT doc_id, class_id, n_copies FROM docs JOIN cl USING (text)),
p AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM hd h1 JOIN hd h2 ON h1.h = h2.h JOIN m x ON x.doc_id = h1.doc_id JOIN m y ON y.doc_id = h2.doc_id WHERE x.class_id <> y.class_id), l AS (SELECT a, count(*) AS n_links FROM p GROUP BY 1)
SELECT m.doc_id, m.class_id, m.n_copies, coalesce(l.n_links, 0) AS n_links FROM m LEFT JOIN l ON l.a = m.class_id"""
