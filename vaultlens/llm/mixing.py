"""Mixing sources to target weights: Pfair blocks, drawn earliest deadline first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sizing import bounded_join
from ..session import cut

PERIOD = 10_000


def quotas(weights: list[float], period: int = PERIOD) -> list[int]:
    """Blocks of each source in one period: the shares in whole numbers by largest remainder, at least 1."""
    total = sum(weights)
    exact = [w / total * period for w in weights]
    out = [max(1, int(e)) for e in exact]
    by_rest = sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))
    while sum(out) < period:
        for i in by_rest[: period - sum(out)]:
            out[i] += 1
    while sum(out) > period:
        out[max(range(len(out)), key=lambda i: (out[i] - exact[i]) if out[i] > 1 else -1e18)] -= 1
    return out


def schedule(quota: list[int]) -> list[list[int]]:
    """Slots of each source's blocks in one period.

    Block i of a source with q of P blocks is released at floor(i P / q) and due by
    ceil((i + 1) P / q); each slot goes to the released block that is due first, ties to
    the window that overlaps the next one, then to the larger weight. So every source is less than one
    block off its share at any time, and the schedule repeats after P slots.
    """
    period = sum(quota)
    waiting = [(0, s, 0) for s in range(len(quota))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int, int]] = []
    slots: list[list[int]] = [[] for _ in quota]
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            q = quota[s]
            due = -(-(i + 1) * period // q)
            overlaps = (i + 1) * period % q != 0
            heapq.heappush(ready, (due, not overlaps, -q, s, i))
        if not ready:
            continue
        *_, s, i = heapq.heappop(ready)
        slots[s].append(t)
        if i + 1 < quota[s]:
            heapq.heappush(waiting, ((i + 1) * period // quota[s], s, i + 1))
    return slots


def amounts(targets: list[tuple[int, str, float, int]], have: dict[str, int], too_small: float = 0.25) -> dict[tuple[int, str], int]:
    """Tokens to draw per (mix, source).

    A source supports the mix size at which its share uses up its texts and their repeats. The usual size is the
    median of what the sources support; a source votes with its share, or with its part of all that is there
    if that is less, so a source with hardly a text and a rich one of small share count for little. A
    source that supports less than ``too_small`` of the usual size, an absent one included, doesn't limit the
    mix: it gives all it has, and the actual shares show what is short. The mix is the largest in which every
    other source gets its share and none is repeated more often than allowed.
    """
    out: dict[tuple[int, str], int] = {}
    for mix in {m for m, *_ in targets}:
        rows = [(s, w, r * have.get(s, 0)) for m, s, w, r in targets if m == mix]
        total = sum(c for *_, c in rows)
        lines = sorted(((c / w, min(w, c / total)) for _, w, c in rows if w > 0 and c > 0), reverse=True)
        reach, usual = 0.0, 0.0
        for supported, vote in lines:
            reach, usual = reach + vote, supported
            if reach >= sum(v for _, v in lines) / 2:
                break
        size = min((n for n, _ in lines if n >= too_small * usual), default=0)
        out |= {(mix, s): min(round(w * size), c) for s, w, c in rows}
    return out


def _slots(batches: Iterator[pa.RecordBatch], tables: dict, block: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key, at = b.column("k").to_numpy(zero_copy_only=False), b.column("at").to_numpy(zero_copy_only=False)
        slot = np.zeros(len(key), np.int64)
        for k in np.unique(key):
            own = key == k
            table, period = tables[int(k)]
            j = at[own] // block
            slot[own] = j // len(table) * period + table[j % len(table)]
        yield pa.RecordBatch.from_arrays([b.column("mix_id"), pa.array(slot), *(b.column(n) for n in ("source", "doc_id", "repeat_no", "n_tokens"))], names=["mix_id", "slot", "source", "doc_id", "repeat_no", "n_tokens"])


def running(sizes: DataFrame, per_bucket: int = 50_000) -> DataFrame:
    """Adds at: the tokens of the same source before each text, in hash order.

    The order is cut into hash buckets of about ``per_bucket`` rows, whose sums are added up first; so a
    source with a third of all rows is summed in many tasks.
    """
    n = max(1, sizes.count() // per_bucket)
    rows = sizes.withColumn("h", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 63) - 1))).withColumn("bucket", F.floor(F.shiftright("h", 32) * n / F.lit(1 << 31)).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("c"))
    firsts = sums.withColumn("first", F.coalesce(F.sum("c").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    line = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(line), F.lit(0)))
    return bounded_join(inner, cut(firsts, "firsts"), ["source", "bucket"], rows=200_000).select("doc_id", "source", "n_tokens", (F.col("first") + F.col("inner")).alias("at"))


def mix(sizes: DataFrame, targets: list[tuple[int, str, float, int]], block: int = 2048) -> tuple[DataFrame, dict]:
    """Draw texts so that each source has its share of the tokens of each mix.

    ``sizes``: doc_id bigint (unique), source string, n_tokens bigint; a written table. ``targets``: (mix_id,
    source, target_share, max_repeats), a few rows. Each mix is as large as its sources allow, without those
    that are far too small for it, which give all they have (``amounts``). The texts of a source are
    drawn in hash order, again from the start when they are used up, until the source's amount is
    reached; the text that crosses it is drawn whole if most of it lies before, so a source is off by at
    most half a text. Null and zero sizes are left out; an empty table gives no rows.

    Columns: mix_id, slot (order in the mix; one block of ``block`` tokens of one source each), source,
    doc_id, repeat_no (from 0), n_tokens. Also returns the amounts aimed at.
    """
    spark = sizes.sparkSession
    wanted = sizes.where("n_tokens > 0 and source is not null")
    have = {r["source"]: int(r["c"]) for r in wanted.join(F.broadcast(spark.createDataFrame([(s,) for s in {t[1] for t in targets}], "source string")), "source").groupBy("source").agg(F.sum("n_tokens").alias("c")).collect()}  # at most the targets' sources
    aims = amounts(targets, have)
    tables, rows = {}, []
    for m in sorted({t[0] for t in targets}):
        own = [(s, aims[m, s]) for mm, s, *_ in targets if mm == m and aims[m, s] > 0]
        if own:
            quota = quotas([float(a) for _, a in own])
            for (s, a), slots in zip(own, schedule(quota)):
                tables[len(rows)] = (np.array(slots, np.int64), sum(quota))
                rows.append((len(rows), m, s, a, have[s]))
    aimed = spark.createDataFrame(rows or [(-1, -1, None, 0, 1)], "k int, mix_id int, source string, aim bigint, have bigint")
    placed = running(wanted.join(F.broadcast(aimed.select("source").distinct()), "source", "left_semi")).join(F.broadcast(aimed), "source")
    turns = F.ceil((F.col("aim") - F.col("at")) / F.col("have"))
    copies = placed.where("at < aim").select("k", "mix_id", "source", "doc_id", "n_tokens", "at", "have", "aim", F.explode(F.sequence(F.lit(0), (turns - 1).cast("int"))).alias("repeat_no"))
    near = 2 * (F.col("at") + F.col("repeat_no") * F.col("have")) + F.col("n_tokens") <= 2 * F.col("aim")
    drawn = copies.where(near).select("k", "mix_id", "source", "doc_id", "repeat_no", "n_tokens", (F.col("at") + F.col("repeat_no") * F.col("have")).alias("at"))
    held = spark.sparkContext.broadcast(tables)
    return drawn.mapInArrow(lambda it: _slots(it, held.value, block), "mix_id int, slot bigint, source string, doc_id bigint, repeat_no int, n_tokens bigint"), aims


def shares(drawn: DataFrame, targets: list[tuple[int, str, float, int]]) -> DataFrame:
    """Target and actual share of every source of every mix, absent ones with 0."""
    spark = drawn.sparkSession
    aim = spark.createDataFrame([(int(m), s, float(w), int(r)) for m, s, w, r in targets], "mix_id int, source string, target_share double, max_repeats int")
    got = drawn.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_texts"), (F.max("repeat_no") + 1).alias("repeats"))
    whole = Window.partitionBy("mix_id")
    return aim.join(got, ["mix_id", "source"], "left").na.fill(0, ["n_tokens", "n_texts", "repeats"]).withColumn("actual_share", F.coalesce(F.col("n_tokens") / F.nullif(F.sum("n_tokens").over(whole), F.lit(0)), F.lit(0.0)))
