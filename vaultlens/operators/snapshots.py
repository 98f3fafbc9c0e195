"""What changed between full snapshots: validity intervals and the events they imply."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import hash_pair
from ..plans.sizing import bounded_join


def snapshot_intervals(df: DataFrame, *, group: str, seq: str, key: str, values: list[str], version: str, broadcast_rows: int = 100_000) -> DataFrame:
    """Maximal runs of consecutive present snapshots in which a record keeps its values.

    Of the rows of one record (group, seq, key) the one with the largest ``version``
    counts (null is the smallest; of equal versions with other values the one with the
    larger row hash). Snapshots are numbered 1, 2, ... within their group by the seq
    values present, so a snapshot that never came leaves no gap. Rows that repeat count
    once. A row without group or seq names no snapshot and is left out; a row without
    key makes its snapshot present but is no record. Null values equal null only. An
    empty table gives no rows; other columns of ``df`` are ignored.

    Columns: grp, key, first_pos, last_pos, first_seq (of the interval), next_seq (of the
    snapshot after it, null if the interval reaches the last one).

    Plan: one pre-aggregated shuffle per record, which also absorbs a record delivered
    very often, then one on (group, key); the islands' aggregate reuses that one.
    """
    h1, h2 = hash_pair(*[F.col(v) for v in values])
    rows = df.select(F.col(group).alias("grp"), F.col(seq).alias("seq"), F.col(key).alias("key"), F.struct(F.col(version).alias("d"), h1.alias("h1"), h2.alias("h2")).alias("r")).where(F.col("grp").isNotNull() & F.col("seq").isNotNull())
    by_seq = Window.partitionBy("grp").orderBy("seq")
    present = df.select(F.col(group).alias("grp"), F.col(seq).alias("seq")).where(F.col("grp").isNotNull() & F.col("seq").isNotNull()).distinct().select("grp", "seq", F.row_number().over(by_seq).alias("pos"), F.lead("seq").over(by_seq).alias("next_seq"))
    records = rows.where(F.col("key").isNotNull()).groupBy("grp", "key", "seq").agg(F.max("r").alias("r")).select("grp", "key", "seq", "r.h1", "r.h2")
    placed = bounded_join(records, present, ["grp", "seq"], rows=broadcast_rows)
    line = Window.partitionBy("grp", "key").orderBy("pos")
    same = (F.lag("pos").over(line) == F.col("pos") - 1) & (F.lag("h1").over(line) == F.col("h1")) & (F.lag("h2").over(line) == F.col("h2"))
    broken = placed.withColumn("starts", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    islands = broken.withColumn("island", F.sum("starts").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("grp", "key", "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("seq").alias("first_seq"), F.when(F.count("next_seq") == F.count("*"), F.max("next_seq")).alias("next_seq")).drop("island")


def snapshot_changes(df: DataFrame, **how) -> DataFrame:
    """Change events between each snapshot and the next one present in its group.

    Takes the arguments of ``snapshot_intervals``, whose rules hold. An interval that
    starts after the first snapshot and touches no earlier interval of its key is an
    ``added``, one that touches is a ``changed``; an interval that ends before the last
    snapshot without a touching successor is a ``removed``, told for the snapshot after
    it. Columns: grp, seq (of the newer snapshot), key, change_kind.
    """
    line = Window.partitionBy("grp", "key").orderBy("first_pos")
    spans = snapshot_intervals(df, **how).select("*", F.lag("last_pos").over(line).alias("before"), F.lead("first_pos").over(line).alias("after"))
    touches = F.coalesce(F.col("before") == F.col("first_pos") - 1, F.lit(False))
    start = F.when(touches, F.lit("changed")).when(F.col("first_pos") > 1, F.lit("added"))
    end = F.when(F.col("next_seq").isNotNull() & F.coalesce(F.col("after") > F.col("last_pos") + 1, F.lit(True)), F.lit("removed"))
    events = F.array(F.struct(F.col("first_seq").alias("seq"), start.alias("change_kind")), F.struct(F.col("next_seq").alias("seq"), end.alias("change_kind")))
    return spans.select("grp", "key", F.inline(events)).where(F.col("change_kind").isNotNull()).select("grp", "seq", "key", "change_kind")
