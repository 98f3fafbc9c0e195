"""Filling fixed-capacity containers: configuration linear program over the length histogram."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import bounded_join
from ..session import cut

BUCKETS, BUCKET_ROWS = 4, 4_000_000


def length_classes(lengths: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Class of each length: at most ``most`` runs of neighbouring lengths.

    Items count as the longest of their class, so a class of n items and width w wastes about n * w / 2. With so many
    classes the waste is least where widths go with the root of 1 / density: each class has the same sum of the roots of
    count times gap.
    """
    if len(lengths) <= most:
        return np.arange(len(lengths))
    weight = np.sqrt(counts * np.diff(lengths, prepend=lengths[0] - 1).astype(float))
    middle = np.cumsum(weight) - weight / 2
    part = np.minimum((middle * most / weight.sum()).astype(int), most - 1)
    return np.unique(part, return_inverse=True)[1]


def best_pattern(sizes: np.ndarray, values: np.ndarray, bounds: np.ndarray, capacity: int) -> np.ndarray:
    """Bounded knapsack by dynamic programming: how many items of each class fill one container best."""
    best = np.zeros(capacity + 1)
    steps: list[tuple[int, int, np.ndarray]] = []
    for k in np.flatnonzero(values > 0):
        left, chunk = min(int(bounds[k]), capacity // int(sizes[k])), 1
        while left > 0:
            m = min(chunk, left)
            left, chunk = left - m, chunk * 2
            w = m * int(sizes[k])
            if w > capacity:
                break
            more = best[: capacity + 1 - w] + m * values[k]
            taken = more > best[w:]
            best[w:] = np.where(taken, more, best[w:])
            steps.append((k, m, taken))
    out, room = np.zeros(len(sizes), np.int64), capacity
    for k, m, taken in reversed(steps):
        w = m * int(sizes[k])
        if room >= w and taken[room - w]:
            out[k] += m
            room -= w
    return out


def priced_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, step: float = 0.5, rate: float = 1.0, power: float = 1.15) -> list[tuple[np.ndarray, int]]:
    """Configuration LP (cover the demand of all classes with the fewest containers) by multiplicative weights: patterns
    and in how many containers each is used. All demand is covered, each item once.

    A class's weight starts as (size / capacity) ** ``power``, near the prices of a perfect packing but a little dearer for
    large items, which only fit while there are small ones; it is multiplied by exp(``rate`` * d), d being how far the
    class's uncovered share is above the mean. The pattern that weighs most is priced by ``best_pattern``, with at most twice a
    class's fair part of a container, and taken as often as covers the share ``step`` of what its scarcest class has left.
    These are whole containers, so rounding happens as it goes: a step below one container is one. Each pricing thus covers at
    least half of a class or ends one, and the number of pricings goes with the logarithm of the number of items.
    """
    left, used = demand.astype(np.int64).copy(), []
    price = (sizes / capacity) ** power
    while left.any():
        share = left / demand
        containers = max(1, -(-int(left @ sizes) // capacity))
        fair = np.minimum(left, -(-2 * left // containers))
        a = best_pattern(sizes, np.where(left > 0, price * np.exp(rate * (share - share[left > 0].mean())), 0), fair, capacity)
        times = max(1, int(step * (left[a > 0] // a[a > 0]).min()))
        left -= times * a
        used.append((a, times))
    return used


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, most_classes: int = 256) -> tuple[np.ndarray, np.ndarray, int]:
    """Where the items go, from the histogram alone (lengths below the capacity).

    Returns the class of each length; rows (class, first rank, container of it, items per container); and the number of
    containers. Ranks count the items of a class from the longest. The rows are as many as the patterns have classes.
    """
    cls = length_classes(lengths, counts, most_classes)
    k = int(cls.max()) + 1 if len(cls) else 0
    if not k:
        return cls, np.empty((0, 4), np.int64), 0
    sizes = np.zeros(k, np.int64)
    np.maximum.at(sizes, cls, lengths)
    rows: list[tuple[int, int, int, int]] = []
    at, box = np.zeros(k, np.int64), 0
    for pattern, times in priced_patterns(sizes, np.bincount(cls, counts).astype(np.int64), capacity):
        for c in np.flatnonzero(pattern):
            rows.append((c, at[c], box, pattern[c]))
            at[c] += times * pattern[c]
        box += times
    return cls, np.array(sorted(rows), np.int64).reshape(-1, 4), box


def _assign(batches: Iterator[pa.RecordBatch], tables: dict) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spec, k, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("spec_id", "cls", "rank"))
        box = np.zeros(len(spec), np.int64)
        for s in np.unique(spec):
            own = spec == s
            t = tables[int(s)]
            at = np.searchsorted((t[:, 0] << 44) + t[:, 1], (k[own].astype(np.int64) << 44) + rank[own], side="right") - 1
            box[own] = t[at, 2] + (rank[own] - t[at, 1]) // t[at, 3]
        yield pa.RecordBatch.from_arrays([b.column("spec_id"), pa.array(box), *(b.column(n) for n in ("doc_id", "piece_no", "n_tokens"))], names=["spec_id", "container_id", "doc_id", "piece_no", "n_tokens"])


def pack(sizes: DataFrame, specs: list[tuple[int, int]], most_classes: int = 256) -> DataFrame:
    """Contents of containers of each capacity.

    ``sizes``: doc_id bigint (unique), n_tokens bigint; must be a written table, it is
    read twice. ``specs``: (spec_id, capacity) pairs. An item larger than a container is split into full ones and a
    rest; no other is. Items of no tokens need no room and stand in container 0. Null sizes are
    left out; an empty table gives no rows; equal sizes are told apart by the hash of doc_id.

    Columns: spec_id, container_id (from 0 within a spec), doc_id, piece_no (from 0), n_tokens.

    The driver sees the histogram only (at most the capacity's number of rows) and decides how many
    containers of which pattern there are (``priced_patterns``, all items in patterns); each item then finds its container
    from its rank within its length class. Ranks are counted in hash buckets per length, 4 or one for each
    4,000,000 rows, so that one length may hold any share of the items. What is broadcast are the patterns: a few thousand rows, growing
    with the logarithm of the number of items.
    """
    buckets = max(BUCKETS, -(-sizes.count() // BUCKET_ROWS))
    spark = sizes.sparkSession
    spec = F.explode(F.array(*[F.struct(F.lit(int(s)).alias("spec_id"), F.lit(int(c)).cast("bigint").alias("capacity")) for s, c in specs]))
    each = sizes.where(F.col("n_tokens").isNotNull()).select("doc_id", F.col("n_tokens").alias("n"), spec.alias("s")).select("doc_id", "n", "s.*")
    full = F.floor(F.col("n") / F.col("capacity"))
    rest = F.col("n") - full * F.col("capacity")
    cells = each.withColumn("rest", rest).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    part = cells.where("rest > 0")
    counted = cut(part.groupBy("spec_id", "rest", "bucket").agg(F.count("*").alias("c")), "histogram")
    tables, classes, boxes = {}, [], {}
    hist = counted.groupBy("spec_id", "rest").agg(F.sum("c").alias("c")).toPandas()  # bounded by the capacities
    for s, c in specs:
        h = hist[hist["spec_id"] == s].sort_values("rest")
        lengths = h["rest"].to_numpy(np.int64)
        cls, tables[int(s)], boxes[int(s)] = plan(lengths, h["c"].to_numpy(np.int64), int(c), most_classes)
        classes += [(int(s), int(n), int(k)) for n, k in zip(lengths, cls)]
    if not classes:
        classes = [(-1, -1, -1)]
    class_of = spark.createDataFrame(classes, "spec_id int, rest bigint, cls int")  # bounded by the capacities
    line = Window.partitionBy("spec_id", "cls").orderBy(F.desc("rest"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counted.join(F.broadcast(class_of), ["spec_id", "rest"]).withColumn("first", F.coalesce(F.sum("c").over(line), F.lit(0))).drop("c"), "starts")
    keys = ["spec_id", "rest", "bucket"]
    ranked = bounded_join(part.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id"))), starts, keys, rows=300_000)
    items = ranked.select("spec_id", "cls", (F.col("first") + F.col("nth") - 1).alias("rank"), "doc_id", full.cast("int").alias("piece_no"), F.col("rest").alias("n_tokens"))
    held = spark.sparkContext.broadcast(tables)
    packed = items.mapInArrow(lambda it: _assign(it, held.value), "spec_id int, container_id bigint, doc_id bigint, piece_no int, n_tokens bigint")
    return packed.unionByName(_full_containers(each, full, boxes, buckets * 8)).unionByName(each.where("n = 0").select("spec_id", F.lit(0).cast("bigint").alias("container_id"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("n_tokens")))


def _full_containers(each: DataFrame, full, boxes: dict[int, int], buckets: int) -> DataFrame:
    """Pieces that fill a container of their own, numbered after the others: running sums over hash buckets."""
    large = each.where(F.col("n") >= F.col("capacity")).withColumn("full", full).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    sums = large.groupBy("spec_id", "bucket").agg(F.sum("full").alias("c")).withColumn("first", F.coalesce(F.sum("c").over(Window.partitionBy("spec_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    base = F.create_map(*[F.lit(x) for s, b in boxes.items() for x in (int(s), int(b))])
    line = Window.partitionBy("spec_id", "bucket").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = large.withColumn("before", F.coalesce(F.sum("full").over(line), F.lit(0))).join(F.broadcast(sums), ["spec_id", "bucket"])  # a row per spec and bucket
    return placed.select("spec_id", "doc_id", "capacity", (base[F.col("spec_id")] + F.col("first") + F.col("before")).alias("start"), F.posexplode(F.array_repeat(F.lit(1), F.col("full").cast("int"))).alias("piece_no", "one")).select("spec_id", (F.col("start") + F.col("piece_no")).cast("bigint").alias("container_id"), "doc_id", "piece_no", F.col("capacity").alias("n_tokens"))


def fills(contents: DataFrame, specs: DataFrame) -> DataFrame:
    """Per container: items, tokens and the filled share. ``specs``: spec_id, capacity (a few rows)."""
    return contents.groupBy("spec_id", "container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("used_tokens")).join(F.broadcast(specs), "spec_id").withColumn("fill", F.col("used_tokens") / F.col("capacity"))
