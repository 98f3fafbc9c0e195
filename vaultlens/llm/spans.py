"""Long exact spans shared between records, found by difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import hash_pair
from ..plans.sizing import bounded_join, shuffle_partitions
from ..session import cut

# A perfect difference set modulo 91. Every residue is a difference of two of its members.
PERIOD = 91
COVER = (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)

PIECE = 1 << 20  # bytes whose running sums are held at once
UNIT = 1 << 24  # bytes of texts whose anchors are sorted at once
MUL2 = np.uint64(0xD6E8FEB86659FD93)
TWO_HASHES = ((0xB5026F5AA96619E9, 5), (0x9E3779B97F4A7C15, 6))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MUL2
    return h ^ (h >> np.uint64(29))


def _powers(base: int, seed: int, n: int, _held: dict = {}) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of an odd number and of its inverse modulo 2**64, and a random number per byte, kept between calls."""
    if base not in _held or len(_held[base][0]) < n:
        parts = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, np.uint64(b))
            steps[0] = 1
            parts.append(np.multiply.accumulate(steps))
        _held[base] = (*parts, np.random.default_rng(seed).integers(1, 2**64, 256, np.uint64, endpoint=False))
    return _held[base]


def window_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end] for each window; ``start`` ascends. Running sums of one piece at a time give all windows that begin in it."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    reach = int((end - start).max())
    up, down, number = _powers(*TWO_HASHES[which], PIECE + max(reach, 4096))
    for p in range(0, len(data), PIECE):
        lo, hi = np.searchsorted(start, (p, p + PIECE))
        if lo == hi:
            continue
        x = data[p : p + PIECE + reach]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(number[x] * up[: len(x)], out=sums[1:])
        out[lo:hi] = _mix((sums[end[lo:hi] - p] - sums[start[lo:hi] - p]) * down[start[lo:hi] - p])
    return out


def _runs_of_rows(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of together at most ``most`` bytes, or of one row."""
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if len(sizes):
        yield lo, len(sizes)


class Letters(NamedTuple):
    """Texts laid end to end: their bytes, where each character begins (and the end), each text's first character and length."""

    data: np.ndarray
    at: np.ndarray
    first: np.ndarray
    count: np.ndarray


def letters(column: pa.Array) -> Letters:
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(column) and column.buffers()[2] else np.empty(0, np.uint8)
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    edge = np.searchsorted(at, ends - ends[0]) if len(column) else np.zeros(1, np.int64)
    return Letters(data, at, edge[:-1], np.diff(edge))


def cover_places(count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Character positions of each text at which a window is hashed: text number and position, in order."""
    room = np.maximum(count - width + 1, 0)
    longest = int(room.max()) if len(room) else 0
    offsets = (np.arange(0, longest, PERIOD)[:, None] + np.array(COVER)[None, :]).ravel()
    n = np.searchsorted(offsets, room)
    owner = np.repeat(np.arange(len(count)), n)
    return owner, offsets[np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)]


def _planes(x: np.ndarray) -> bytes:
    """uint32 numbers byte by byte, low bytes first: the high ones are mostly equal and compress away."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


ANCHORS = "place int, kind int, keys binary, labels binary, counts binary, places binary"
MEMBERS, SPREAD, MARKED = 0, 1, 2


def _emit(batches: Iterator[pa.RecordBatch], ranges: int, width: int, crowd: int) -> Iterator[pa.RecordBatch]:
    """Anchors of the texts, packed into one row per unit of texts and hash range.

    A row holds the lower 32 bits of the hashes, the texts with the number of their anchors, in order, and the
    anchors' positions. An anchor that stands over ``crowd`` times in a unit doesn't go to its range: its members are
    spread evenly (SPREAD), and only its key is told there (MARKED), so that an anchor of all texts burdens no task.
    """
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        _, once = np.unique(label, return_index=True)
        once.sort()
        rows = batch.take(pa.array(once))
        label, text = label[once], rows.column(1).cast(pa.large_binary())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        for lo, hi in _runs_of_rows(np.diff(ends), UNIT):
            yield from _emit_unit(label[lo:hi].astype(np.int64), letters(text.slice(lo, hi - lo)), ranges, width, crowd)


def _emit_unit(names: np.ndarray, t: Letters, ranges: int, width: int, crowd: int) -> Iterator[pa.RecordBatch]:
    owner, place = cover_places(t.count, width)
    if not len(owner):
        return
    c = t.first[owner] + place
    h = window_hashes(t.data, t.at[c], t.at[c + width])
    ordered = np.sort(h)
    crowded = np.unique(ordered[crowd:][ordered[crowd:] == ordered[:-crowd]])
    # range from the upper 32 bits, key from the lower 32 and so independent of it
    part = ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
    out: dict[str, list] = {n: [] for n in ("place", "kind", "keys", "labels", "counts", "places")}

    def add(where: int, kind: int, keys: np.ndarray, own: np.ndarray, places: np.ndarray) -> None:
        new = np.flatnonzero(np.diff(own, prepend=-1))
        for n, v in zip(out, (where, kind, keys.astype("<u4").tobytes(), names[own[new]].tobytes(), np.diff(new, append=len(own)).astype(np.uint32).tobytes(), _planes(places))):
            out[n].append(v)

    if len(crowded):
        apart = np.isin(h, crowded)
        add(int(names[0] % ranges), SPREAD, np.empty(0, np.uint32), owner[apart], place[apart])
        none = np.empty(0, np.int64)
        kp = ((crowded >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        for r in np.unique(kp):
            add(int(r), MARKED, (crowded[kp == r] & np.uint64(0xFFFFFFFF)), none, none)
        h, part, owner, place = h[~apart], part[~apart], owner[~apart], place[~apart]
    order = np.argsort(part.astype(np.uint16) if ranges <= 1 << 16 else part, kind="stable")
    key, part, owner, place = (h[order] & np.uint64(0xFFFFFFFF)), part[order], owner[order], place[order]
    edge = np.searchsorted(part, np.arange(ranges + 1))
    for r in np.flatnonzero(np.diff(edge)):
        s = slice(edge[r], edge[r + 1])
        add(int(r), MEMBERS, key[s], owner[s], place[s])
    yield pa.RecordBatch.from_arrays([pa.array(out["place"], pa.int32()), pa.array(out["kind"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in ("keys", "labels", "counts", "places"))], names=list(out))


def _pairs_of_groups(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within groups that lie one after another."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for m in np.unique(size):
        base = first[size == m]
        i, j = np.triu_indices(m, 1)
        left.append((base[:, None] + i[None, :]).ravel())
        right.append((base[:, None] + j[None, :]).ravel())
    return np.concatenate(left), np.concatenate(right)


MET = "a bigint, b bigint, pa int, pb int"


def _told(a: np.ndarray, pos: np.ndarray, b: np.ndarray | None = None, to: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(n, pa.int64()) if b is None else pa.array(b), pa.array(pos.astype(np.int32)), pa.nulls(n, pa.int32()) if to is None else pa.array(to.astype(np.int32))], names=["a", "b", "pa", "pb"])


def _meet(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """One hash range: aligned anchors of two texts (a < b, with their positions).

    Anchors that are crowded, that more than ``hot`` texts share, or that a text holds several times aren't paired: each
    member is told alone (b is null)."""
    held: dict[str, list] = {"key": [], "label": [], "pos": []}
    marked = [np.empty(0, np.uint32)]
    for batch in batches:
        for kind, keys, labels, counts, places in zip(*(batch.column(n).to_pylist() for n in ("kind", "keys", "labels", "counts", "places"))):
            key = np.frombuffer(keys, "<u4")
            if kind == MARKED:
                marked.append(key)
                continue
            label = np.repeat(np.frombuffer(labels, np.int64), np.frombuffer(counts, np.uint32))
            pos = _numbers(places)
            if kind == SPREAD:
                yield _told(label, pos)
                continue
            for n, v in zip(held, (key, label, pos)):
                held[n].append(v)
    if not held["key"]:
        return
    key, label, pos = (np.concatenate(held.pop(n)) for n in list(held))
    crowded = np.unique(np.concatenate(marked))
    order = np.argsort(key, kind="stable")
    alone = key[order]
    same = alone[1:] == alone[:-1]
    alike = np.r_[same, False] | np.r_[False, same]
    if len(crowded):
        alike |= crowded[np.minimum(np.searchsorted(crowded, alone), len(crowded) - 1)] == alone
    order = order[alike]
    key, label, pos = key[order], label[order], pos[order]
    order = np.lexsort((pos, label, key))
    key, label, pos = key[order], label[order], pos[order]
    if not len(key):
        return
    # copies of a text in other units bring the same anchor again
    fresh = np.r_[True, (key[1:] != key[:-1]) | (label[1:] != label[:-1]) | (pos[1:] != pos[:-1])]
    key, label, pos = key[fresh], label[fresh], pos[fresh]
    new = np.r_[True, key[1:] != key[:-1]]
    first = np.flatnonzero(new)
    size = np.diff(first, append=len(key))
    texts = np.add.reduceat((new | np.r_[True, label[1:] != label[:-1]]).astype(np.int64), first)
    jam = np.zeros(len(first), bool)
    if len(crowded):
        jam = crowded[np.minimum(np.searchsorted(crowded, key[first]), len(crowded) - 1)] == key[first]
    cold = ~jam & (texts == size) & (texts > 1) & (texts <= hot)
    i, j = _pairs_of_groups(first[cold], size[cold])
    for s in range(0, len(i), 1 << 20):
        yield _told(label[i[s : s + (1 << 20)]], pos[i[s : s + (1 << 20)]], label[j[s : s + (1 << 20)]], pos[j[s : s + (1 << 20)]])
    lone = np.repeat(~cold & (jam | (texts > 1)), size)
    if lone.any():
        yield _told(label[lone], pos[lone])


def _deepen(batches: Iterator[pa.RecordBatch], width: int, least: int) -> Iterator[pa.RecordBatch]:
    """Two hashes of every window of ``least`` characters that holds one of the given anchors."""
    for batch in batches:
        label, text, spots = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.large_binary()), batch.column(2)
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        for lo, hi in _runs_of_rows(np.diff(ends), UNIT // 8):
            t, own = letters(text.slice(lo, hi - lo)), spots.slice(lo, hi - lo)
            n = own.value_lengths().to_numpy(zero_copy_only=False)
            who = np.repeat(np.arange(hi - lo), n)
            spot = own.flatten().to_numpy(zero_copy_only=False) + t.first[who]
            a = np.maximum(spot - (least - width), t.first[who])
            b = np.minimum(spot, t.first[who] + t.count[who] - least)
            a, b = a[b >= a], b[b >= a]
            open_ = np.bincount(a, minlength=len(t.at) + 1) - np.bincount(b + 1, minlength=len(t.at) + 1)
            begin = np.flatnonzero(np.cumsum(open_) > 0)
            s, e = t.at[begin], t.at[begin + least]
            who = np.searchsorted(t.first, begin, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(pa.array(window_hashes(t.data, s, e, k).view(np.int64)) for k in (0, 1)), pa.array(label[lo:hi][who].astype(np.int64)), pa.array((begin - t.first[who]).astype(np.int32))], names=["h1", "h2", "label", "begin"])


def _common_prefix(x: Column, y: Column, most: int) -> Column:
    """Length of the longest common prefix of two texts of at most ``most`` characters, by bisection."""
    steps = [1 << k for k in reversed(range(most.bit_length()))]
    both = F.least(F.length(x), F.length(y))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, s: F.when((n + s <= both) & (F.substring(x, F.lit(1), n + s) == F.substring(y, F.lit(1), n + s)), n + s).otherwise(n))


def _extended(chains: DataFrame, bodies: DataFrame, width: int) -> DataFrame:
    """The run of equal characters around each chain of anchors (a, b, shift, first, last): start in a, n_chars, and
    whether the first anchor really is equal.

    Before the first and behind the last anchor of a run fewer than 91 characters are equal, as any more would
    hold another anchor; so only so many are shipped and compared.
    """
    side = PERIOD - 1

    def parts(shift, to):
        at, end = F.col("first") + shift, F.col("last") + shift + width
        begin = F.greatest(at - side, F.lit(0))
        return [F.reverse(F.substring("text", begin + 1, at - begin)).alias(f"left_{to}"), F.substring("text", end + 1, F.lit(side)).alias(f"right_{to}"), F.xxhash64(F.substring("text", at + 1, F.lit(width))).alias(f"anchor_{to}")]

    keys = ["a", "b", "shift", "first", "last"]
    half = chains.join(bodies.withColumnRenamed("label", "a"), "a").select(*keys, *parts(F.lit(0), "a"))
    both = half.join(bodies.withColumnRenamed("label", "b"), "b").select(*keys, "left_a", "right_a", "anchor_a", *parts(F.col("shift"), "b"))
    left, right = (_common_prefix(F.col(f"{s}_a"), F.col(f"{s}_b"), side) for s in ("left", "right"))
    grown = both.select(*keys, left.alias("l"), right.alias("r"), (F.col("anchor_a") == F.col("anchor_b")).alias("is_equal"))
    return grown.select(*keys, (F.col("first") - F.col("l")).alias("start"), (F.col("last") - F.col("first") + width + F.col("l") + F.col("r")).alias("n_chars"), "is_equal")


class SharedSpans(NamedTuple):
    """What is shared between texts. ``facts``: doc_id, label, n of each text that isn't null; equal texts share a label.
    ``runs``: label, other, start, n_chars, told from both sides. ``windows``: label, begin of windows of the least
    length that other texts hold too; ``cliques``: clique, label: texts that share such a window with each other."""

    facts: DataFrame
    runs: DataFrame
    windows: DataFrame | None
    cliques: DataFrame | None


def text_classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """doc_id, label and length of every text that is not null, and the label as an expression of the text.

    Equal texts share a label, others never do: it is the first of two 64-bit hashes, or the second for the few
    texts that agree with another in the first only (about n * n / 2**65 of n texts)."""
    h1, h2 = hash_pair(F.col(text_col))
    facts = cut(docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), h1.alias("label"), h2.alias("second"), F.length(text_col).alias("n")), "facts")
    clash = [(r["label"], r["m"]) for r in facts.groupBy("label").agg(F.min("second").alias("m"), F.max("second").alias("x")).where("m <> x").limit(10_001).collect()]
    if len(clash) > 10_000:
        raise ValueError("over 10,000 texts agree in one hash of two")
    if not clash:
        return facts.drop("second"), h1
    pick = lambda a, b: F.coalesce(*[F.when((a == k) & (b != m), b) for k, m in clash], a)
    return facts.withColumn("label", pick(F.col("label"), F.col("second"))).drop("second"), pick(h1, h2)


def shared_spans(docs: DataFrame, *, id_col: str, text_col: str, least: int = 240, hot: int = 64, crowd: int = 32) -> SharedSpans:
    """Stretches of at least ``least`` characters (code points) that also stand in another text.

    Equal texts are one class (label), so copies bring no pairs. Null and shorter texts have no runs; an empty table
    gives no rows; other columns are ignored; ids must be unique.

    Windows of ``least`` - 90 characters are hashed only at positions whose remainder by 91 lies in the cover; two places of
    a common run of ``least`` characters have a common offset below 91 at which both lie in the cover. Texts that
    share such an anchor at positions (p, q) are extended from there: anchors of one pair, of one shift q - p and at most 91
    characters apart are one run, whose ends are then compared character by character.

    An anchor of more than ``hot`` texts, or that a text repeats, would pair too much. Its members are extended one by
    one: all windows of ``least`` characters around it are hashed (128 bits), one row per text and window, and windows
    held by two or more texts are shared. Of the windows with the same set of texts one stands for all (a clique), so pairs
    come from each set once. Whether an anchor is paired or not never changes the result.
    """
    width, ranges = least - PERIOD + 1, shuffle_partitions(docs, 16 << 20)
    facts, label = text_classes(docs, id_col, text_col)
    texts = docs.where(F.length(text_col) >= least).select(label.alias("label"), F.col(text_col).alias("text"))
    packed = texts.mapInArrow(lambda it: _emit(it, ranges, width, crowd), ANCHORS)
    met = cut(packed.repartitionById(ranges, "place").mapInArrow(lambda it: _meet(it, hot), MET), "met")
    shift = F.col("pb") - F.col("pa")
    # the smaller label first, so that a pair met in several ranges is one
    aligned = met.where("b is not null").select("a", "b", shift.alias("shift"), "pa")
    line = Window.partitionBy("a", "b", "shift").orderBy("pa")
    broken = F.coalesce(F.col("pa") - F.lag("pa").over(line) > PERIOD, F.lit(True))
    chains = aligned.withColumn("broken", broken.cast("int")).withColumn("chain", F.sum("broken").over(line))
    chains = cut(chains.groupBy("a", "b", "shift", "chain").agg(F.min("pa").alias("first"), F.max("pa").alias("last")).drop("chain"), "chains")
    lone = met.where("b is null")
    wanted = chains.select(F.col("a").alias("label")).union(chains.select("b")).union(lone.select("a")).distinct()
    reps = facts.where(F.col("n") >= least).groupBy("label").agg(F.min("doc_id").alias("rep_id"))
    wanted = cut(reps.join(wanted, "label", "left_semi"), "wanted")
    source = docs.select(F.col(id_col).alias("rep_id"), F.col(text_col).alias("text"))
    bodies = bounded_join(source, wanted, ["rep_id"], rows=200_000, salts=1).select("label", "text")
    grown = cut(_extended(chains, bodies, width), "grown")
    # a chain whose first anchor agrees by hash only: each of its anchors is extended for itself
    false = grown.where("not is_equal and first < last").select("a", "b", "shift", "first", "last")
    good = grown.where(F.col("is_equal"))
    if not false.isEmpty():
        each = aligned.join(false, ["a", "b", "shift"]).where("pa between first and last").select("a", "b", "shift", F.col("pa").alias("first"), F.col("pa").alias("last"))
        good = good.unionByName(_extended(each, bodies, width).where("is_equal"))
    good = good.where(F.col("n_chars") >= least)
    runs = good.select(F.col("a").alias("label"), F.col("b").alias("other"), "start", "n_chars").unionByName(good.select(F.col("b").alias("label"), F.col("a").alias("other"), (F.col("start") + F.col("shift")).alias("start"), "n_chars"))
    if lone.isEmpty():
        return SharedSpans(facts, runs, None, None)
    spots = lone.groupBy(F.col("a").alias("label")).agg(F.collect_set("pa").alias("spots"))  # at most the anchors of one text
    deep = cut(spots.join(bodies, "label").select("label", "text", "spots").mapInArrow(lambda it: _deepen(it, width, least), "h1 bigint, h2 bigint, label bigint, begin int"), "deep")
    window = ["h1", "h2"]
    holders = deep.select(*window, "label").distinct()
    marks = [F.bit_xor(F.xxhash64(F.lit(s), "label")).alias(f"s{s}") for s in (1, 2)]
    sets = cut(holders.groupBy(*window).agg(F.count("*").alias("k"), *marks).where("k > 1"), "sets")
    one = sets.groupBy("k", "s1", "s2").agg(F.min(F.struct(*window)).alias("w")).select("w.*")
    windows = bounded_join(deep, sets.select(*window), window, rows=500_000).select("label", "begin")
    cliques = cut(bounded_join(holders, one, window, rows=500_000).select(F.struct(*window).alias("clique"), "label"), "cliques")
    return SharedSpans(facts, runs, windows, cliques)


def linked_classes(spans: SharedSpans, salts: int = 8) -> DataFrame:
    """Distinct pairs of labels (a < b) whose texts share a run. One clique may hold a third of all texts: its
    pairs are made in ``salts`` squared tasks."""
    linked = spans.runs.where("label < other").select(F.col("label").alias("a"), F.col("other").alias("b"))
    if spans.cliques is not None:
        salt = F.pmod(F.xxhash64("label"), F.lit(salts))
        every = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(salts)]))
        left = spans.cliques.select("clique", F.col("label").alias("a"), salt.alias("i"), every.alias("j"))
        right = spans.cliques.select("clique", F.col("label").alias("b"), salt.alias("j"), every.alias("i"))
        linked = linked.unionByName(left.join(right, ["clique", "i", "j"]).where("a < b").select("a", "b"))
    return linked.distinct()


def shared_pairs(spans: SharedSpans, least: int = 240) -> DataFrame:
    """doc_a, doc_b (smaller first) of every two records whose texts share a run, copies included.

    The result has a row per pair, so it grows with the square of a group of copies; ``shared_classes`` doesn't."""
    linked = cut(linked_classes(spans), "linked")
    long = spans.facts.where(F.col("n") >= least)
    copies = long.groupBy("label").count().where("count > 1").select(F.col("label").alias("a"), F.col("label").alias("b"))
    left = bounded_join(long.select(F.col("label").alias("a"), F.col("doc_id").alias("x")), linked.unionByName(copies), ["a"], rows=200_000)
    both = left.join(long.select(F.col("label").alias("b"), F.col("doc_id").alias("y")), "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def shared_classes(spans: SharedSpans, least: int = 240) -> DataFrame:
    """Per record its class (the smallest doc_id with the same text), the records of the class and the number of other
    classes of which a text shares a run with it."""
    linked = cut(linked_classes(spans), "linked")
    links = linked.select(F.col("a").alias("label")).unionAll(linked.select("b")).groupBy("label").agg(F.count("*").alias("n_links"))
    classes = spans.facts.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies")).join(links, "label", "left").na.fill(0, ["n_links"])
    plain = spans.facts.select("doc_id", "label")
    return bounded_join(plain, classes, ["label"], rows=200_000).select("doc_id", "class_id", "n_copies", "n_links")


def shared_shares(spans: SharedSpans, least: int = 240) -> DataFrame:
    """Per record the characters that also stand in another record, and their share.

    Only runs of at least ``least`` characters count. A text of that length with a copy is shared as a
    whole. Empty texts have share 0. Columns: doc_id, n_chars, n_shared, share. Common passages come as windows of each text, so no
    pairs are made of the texts that hold one.
    """
    ends = spans.runs.select("label", F.col("start").alias("s"), (F.col("start") + F.col("n_chars")).alias("e"))
    if spans.windows is not None:
        ends = ends.unionByName(spans.windows.select("label", F.col("begin").alias("s"), (F.col("begin") + least).alias("e")))
    line = Window.partitionBy("label").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    covered = ends.distinct().withColumn("before", F.coalesce(F.max("e").over(line), F.lit(0))).groupBy("label").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "before"))).alias("covered"))
    copies = spans.facts.groupBy("label").agg(F.count("*").alias("copies"))
    notable = copies.join(covered, "label", "left").where("copies > 1 or covered is not null")
    n = F.when((F.col("copies") > 1) & (F.col("n") >= least), F.col("n")).otherwise(F.coalesce("covered", F.lit(0))).cast("bigint")
    joined = spans.facts.join(notable, "label", "left").select("doc_id", F.col("n").cast("bigint").alias("n_chars"), n.alias("n_shared"))
    return joined.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("n_shared") / F.col("n_chars"), 6)).otherwise(0.0))
