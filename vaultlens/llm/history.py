"""Deduplicating new batches against all history with immutable arrays of all windows that a similar record must share."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sizing import bounded_join, fits, shuffle_partitions
from ..session import Cut, cut, path, remove, scratch_root

GRAM = 8
COVERAGE = 5
CROWD, SALTS = 256, 16
MUL, MUL2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
DIGEST = np.int64(0x5851F42D4C957F2D)  # digests are hashed with the group xor this
ENTRY, STORED, MARKER, DEFERRED, PROBE = range(5)
WHOLE, MARK = -1, -2  # in place of the number of windows: an entry is a digest, or a marker


def windows(payload: bytes) -> np.ndarray:
    """Distinct 8-byte windows, as sorted big-endian numbers."""
    if len(payload) < GRAM:
        return np.empty(0, np.uint64)
    w = np.ndarray((len(payload) - GRAM + 1,), ">u8", payload, 0, (1,)).astype(np.uint64)
    w.sort()
    new = np.empty(len(w), bool)
    new[0] = True
    np.not_equal(w[1:], w[:-1], out=new[1:])
    return w[new]


def _mix(x: np.ndarray) -> np.ndarray:
    h = x * MUL
    h ^= h >> np.uint64(32)
    h *= MUL2
    h ^= h >> np.uint64(29)
    return h


SLOTS = 1 << 16
SLICE = 2 << 20
LEVELS = 31


def _slots(data: np.ndarray) -> np.ndarray:
    """The counter of the three bytes at each place."""
    x = data.astype(np.uint32)
    return (x[:-2] * np.uint32(40503) ^ x[1:-1] * np.uint32(277) ^ x[2:] * np.uint32(30011)) & np.uint32(SLOTS - 1)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values end to end, and where each begins."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return data, at - at[0]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.int64)
    for b in batches:
        data = _bytes_of(b.column(0))[0]
        for i in range(0, len(data) - 2, SLICE):
            counts += np.bincount(_slots(data[i : i + SLICE + 2]), minlength=SLOTS)
    yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])


def _add_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.int64)
    for b in batches:
        for x in b.column(0):
            counts += np.frombuffer(x.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])


def rarities(sketch: DataFrame) -> np.ndarray:
    """How rare each three bytes are in the payloads, in eighths of a bit. This decides only in which order windows are
    taken, never which records are similar."""
    parts = sketch.select("payload").mapInArrow(_count_grams, "counts binary").repartition(8).mapInArrow(_add_grams, "counts binary").collect()  # 8 rows
    counts = np.sum([np.frombuffer(r[0], np.int64) for r in parts], axis=0)
    return np.clip(8 * np.log2((counts.sum() + 1) / (counts + 1)), 0, 160).astype(np.uint8)


def prefixes(column: pa.Array, costs: np.ndarray, similar: float, cover: int = COVERAGE) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """Of each payload the windows by which all similar ones find it: (row, window) for each, then the first row and the
    number of distinct windows of each row, slice by slice.

    All records put their windows into the same order (rare ones first, by the bytes of the window alone, then by a hash).
    A similar record shares at least ceil(similar * n) of the n windows of a record, so at most n - ceil(similar * n) of
    them are missing there, and among the first n - ceil(similar * n) + cover are the ``cover`` first ones of those both
    have (all of them if they are fewer). That holds in both records, so no similar pair is left out. Two windows of a payload are
    told apart by 59 bits of a hash and their rarity.
    """
    data, at = _bytes_of(column)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, side="right")) - 1)
        part = data[at[i] : at[j]]
        size = np.maximum(np.diff(at[i : j + 1]) - (GRAM - 1), 0)
        ends = np.cumsum(size)
        starts = ends - size
        own = np.repeat(np.arange(j - i), size)
        n = np.zeros(j - i, np.int64)
        if len(own):
            where = np.arange(len(own)) + np.repeat(at[i:j] - at[i] - starts, size)
            w = np.ndarray((len(part) - GRAM + 1,), ">u8", part, 0, (1,)).astype(np.uint64)
            rare = np.concatenate(([0], np.cumsum(costs[_slots(part)], dtype=np.int64)))
            level = LEVELS - (rare[GRAM - 2 :] - rare[: -(GRAM - 2)]) * LEVELS // ((GRAM - 2) * 160)
            key = ((level.astype(np.uint64) << np.uint64(59)) | (_mix(w) >> np.uint64(5)))[where]
            for a, b in zip(starts.tolist(), ends.tolist()):
                key[a:b].sort()
            new = np.empty(len(key), bool)
            new[0] = True
            np.not_equal(key[1:], key[:-1], out=new[1:])
            new[starts[size > 0]] = True
            upto = np.concatenate(([0], np.cumsum(new)))
            n = upto[ends] - upto[starts]
            most = np.minimum(n, n - np.ceil(similar * n - 1e-6).astype(np.int64) + cover)
            take = new & (upto[:-1] - upto[starts][own] < most[own])
            yield own[take] + i, key[take], i, n
        else:
            yield own, np.empty(0, np.uint64), i, n
        i = j


SKETCH = "grp bigint, batch int, id bigint, c1 bigint, c2 bigint, payload binary"


def sketches(records: DataFrame, *, group: str, batch: str, record_id: str, payload: str) -> DataFrame:
    """Records as the history takes them: hashes of group and payload. Rows without payload, group, batch or id are left out."""
    base = records.select(F.col(group).alias("g"), F.col(batch).cast("int").alias("batch"), F.col(record_id).cast("bigint").alias("id"), F.col(payload).alias("payload")).where("g is not null and batch is not null and id is not null and payload is not null")
    digest = F.sha2("payload", 256)
    marks = [F.conv(F.substring(digest, a, 15), 16, 10).cast("bigint") for a in (1, 16)]
    return base.select(F.xxhash64("g").alias("grp"), "batch", "id", marks[0].alias("c1"), marks[1].alias("c2"), "payload")


ENTRIES = "place int, kind int, cells binary"


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: the bytes that are mostly equal compress away."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplaned(raw: memoryview, at: int, m: int, kind: type) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, m * width, at).reshape(width, m).T).view(kind).ravel(), at + m * width


def _packed(grp: np.ndarray, rid: np.ndarray, n: np.ndarray, suffix: np.ndarray) -> bytes:
    """Entries in order of group and suffix: differences of both, the number of each record in a list of records, and that list."""
    ids, index = np.unique(rid, return_inverse=True)
    counts = np.zeros(len(ids), np.int32)
    counts[index] = n
    real = n >= 0
    counts[index[real]] = n[real]
    odd = np.flatnonzero(counts[index] != n)  # digests and markers
    step = lambda x: np.diff(x.view(np.uint64), prepend=np.uint64(0))
    raw = b"".join((_planes(step(grp)), _planes(step(suffix)), _planes(index.astype(np.int32)), _planes(step(ids)), _planes(counts), _planes(odd.astype(np.int32)), _planes(n[odd].astype(np.int32))))
    return struct.pack("<4q", len(rid), len(ids), len(odd), len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    m, k, odds, size = struct.unpack_from("<4q", blob)
    raw = memoryview(pa.decompress(memoryview(blob)[32:], decompressed_size=size, codec="zstd")) if size else memoryview(b"")
    at, out = 0, []
    for count, kind in ((m, np.uint64), (m, np.uint64), (m, np.int32), (k, np.uint64), (k, np.int32), (odds, np.int32), (odds, np.int32)):
        x, at = _unplaned(raw, at, count, kind)
        out.append(np.cumsum(x, dtype=np.uint64).view(np.int64) if kind is np.uint64 else x)
    grp, suffix, index, ids, counts, odd, other = out
    n = counts[index]
    n[odd] = other
    return grp, ids[index], n, suffix


def _named(grp: np.ndarray, window: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Home and 32-bit name of a window of a group. Names of different windows may agree: that only makes a candidate more."""
    h = _mix(window.view(np.uint64) ^ (grp.view(np.uint64) * MUL2))
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), (h << np.uint64(32)).view(np.int64)


def _placed(home: np.ndarray, name: np.ndarray, salt: np.ndarray | int, parts: int) -> np.ndarray:
    """Salt 0 is at home, others elsewhere."""
    salt = np.asarray(salt).astype(np.uint64)
    off = np.where(salt > 0, (_mix(name.view(np.uint64) ^ (salt * MUL)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), 0).astype(np.int64)
    return ((home + off) % parts).astype(np.int32)


def _ordered(home: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The order by home and name."""
    order = np.argsort(name.view(np.uint64))
    if len(home) and (home != home[0]).any():
        order = order[np.argsort(home[order].astype(np.int64), kind="stable")]
    return order


def _rows(place, kind, grp, rid, n, suffix) -> pa.RecordBatch:
    """Entries packed into one row per place."""
    order = _ordered(grp, suffix) if (kind not in (ENTRY, MARKER)) else np.argsort((place.astype(np.uint64) << np.uint64(32)) | (suffix.view(np.uint64) >> np.uint64(32)))
    if kind not in (ENTRY, MARKER):
        order = order[np.argsort(place[order], kind="stable")]
    place, grp, rid, n, suffix = (np.ascontiguousarray(x[order]) for x in (place, grp, rid, n, suffix))
    first = np.flatnonzero(np.diff(place, prepend=-1))
    cells = [_packed(grp[i:j], rid[i:j], n[i:j], suffix[i:j]) for i, j in zip(first, np.append(first[1:], len(place)))]
    return pa.RecordBatch.from_arrays([pa.array(place[first]), pa.array(np.full(len(first), kind, np.int32)), pa.array(cells, pa.binary())], names=["place", "kind", "cells"])


def _spread(batches: Iterator[pa.RecordBatch], parts: int, crowd: int, costs: np.ndarray, similar: float, cover: int) -> Iterator[pa.RecordBatch]:
    """The windows of records, routed by the hash of group and window, and each record's digest as one more.

    A window of more than ``crowd`` records of a scan batch is split: its entries go to one of 16 places by their id, a
    marker to its own place tells so, and its lookups are deferred at once. So a window that a third of all records
    share burdens no task.
    """
    for b in _gathered(batches):
        every = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("grp", "id", "c1")}
        found = list(prefixes(b.column("payload"), costs, similar, cover))
        own, window = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        count = np.concatenate([f[3] for f in found]).astype(np.int32)
        home, name = _named(every["grp"][own], window, parts)
        rid, n = every["id"][own], count[own]
        code = (home.view(np.uint64) << np.uint64(32)) | (name.view(np.uint64) >> np.uint64(32))
        order = np.argsort(code)
        home, name, rid, n, code = (x[order] for x in (home, name, rid, n, code))
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
        size = np.diff(first, append=len(code))
        jam = np.repeat(size > crowd, size)
        calm = ~jam
        digests = _named(every["grp"] ^ DIGEST, every["c1"], parts)
        whole = np.full(b.num_rows, WHOLE, np.int32)
        at = np.concatenate((home[calm], digests[0]))
        yield _rows(at.astype(np.int32), ENTRY, at, np.concatenate((rid[calm], every["id"])), np.concatenate((n[calm], whole)), np.concatenate((name[calm], digests[1])))
        if jam.any():
            yield _rows(_placed(home[jam], name[jam], 1 + rid[jam] % SALTS, parts), STORED, home[jam], rid[jam], n[jam], name[jam])
            yield _rows((rid[jam] % parts).astype(np.int32), DEFERRED, home[jam], rid[jam], n[jam], name[jam])
            head = first[size > crowd]
            yield _rows(home[head].astype(np.int32), MARKER, home[head], np.full(len(head), -1, np.int64), np.full(len(head), MARK, np.int32), name[head])


def _gathered(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together up to some size: entries that are packed together take less."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class SuffixArray(tuple):
    """home, name (a window's hash as a number), id and number of windows of each entry, sorted by home and name. Never changed."""

    @classmethod
    def of(cls, grp, suffix, rid, n) -> SuffixArray:
        order = _ordered(grp, suffix)
        return cls(x[order] for x in (grp, suffix, rid, n))

    @classmethod
    def merged(cls, arrays: list[SuffixArray]) -> SuffixArray:
        return cls.of(*(np.concatenate(x) for x in zip(*arrays)))

    def dump(self) -> bytes:
        grp, suffix, rid, n = self
        return _packed(grp, rid, n, suffix)

    @classmethod
    def load(cls, raw: bytes) -> SuffixArray:
        grp, rid, n, suffix = _unpacked(raw)
        return cls((grp, suffix, rid, n))

    def codes(self, groups: np.ndarray) -> np.ndarray:
        """The order as one number: the home's rank, then the name."""
        return _codes(self[0], self[1], groups)


def _codes(grp: np.ndarray, suffix: np.ndarray, groups: np.ndarray) -> np.ndarray:
    bits = np.uint64(max(1, int(len(groups)).bit_length()))
    rank = np.searchsorted(groups, grp).astype(np.uint64) if len(groups) > 1 else np.uint64(0)
    return (rank << (np.uint64(64) - bits)) | (suffix.view(np.uint64) >> bits)


PIECE = 16 << 20


def stored_arrays(folders: list[str], place: int) -> list[SuffixArray]:
    """The arrays of one range, straight from the shared folder: they never move through a shuffle."""
    out = []
    for folder in folders:
        fs, root = pa_fs.FileSystem.from_uri(f"{folder}/place={place}")
        found = [f.path for f in fs.get_file_info(pa_fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet")]
        pieces = {i: x for f in found for i, x in zip(*(c.to_pylist() for c in pq.read_table(f, columns=["piece", "blob"], filesystem=fs, partitioning=None)))}
        if pieces:
            out.append(SuffixArray.load(b"".join(pieces[i] for i in sorted(pieces))))
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, list[np.ndarray]]:
    """Place and entries (kind, home, id, n, name) of one partition."""
    place, kinds, parts = None, [], []
    for b in batches:
        for p, k, raw in zip(*(b.column(c).to_pylist() for c in ("place", "kind", "cells"))):
            place = p
            parts.append(_unpacked(raw))
            kinds.append(np.full(len(parts[-1][0]), k, np.int32))
    return place, [np.concatenate(x) for x in (kinds, *zip(*parts))] if parts else []


HITS = "a bigint, b bigint, grp bigint, weight int, own boolean, suffix bigint, hits bigint, n int, inner bigint, place int, piece int, blob binary"
HIT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
HIT_NAMES = [f.split()[0] for f in HITS.split(", ")]


def _hits(rows: int, place: int = -1, **columns) -> pa.RecordBatch:
    columns["place"] = np.full(rows, place, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in zip(HIT_NAMES, HIT_TYPES)], names=HIT_NAMES)


def _in_pieces(array: SuffixArray) -> Iterator[tuple[int, bytes]]:
    raw = array.dump()
    for i in range(0, len(raw), PIECE):
        yield i // PIECE, raw[i : i + PIECE]


def _search(batches: Iterator[pa.RecordBatch], hot: int | None, similar: float, folders: list[str], asked: list[str]) -> Iterator[pa.RecordBatch]:
    """One range of windows: each window of the new batch is looked up in the stored arrays by binary search, and among
    the batch's earlier records.

    Tells (a, b, weight, own, n windows of b) for each pair: so many windows of b stand in the earlier record a too, which is of the same
    batch (own) or a stored one; an equal digest weighs 100 windows. A lookup with more than ``hot`` hits is told as deferred instead (a null; home, name, hits, n
    windows of b, hits in the batch). The batch's own array of the range comes out in pieces. Without ``hot`` only probes are
    looked up, and the own array is the one that was told before (``asked``)."""
    place, cells = _read(batches)
    if not cells:
        return
    kind, grp, rid, n, suffix = cells
    wait = kind == DEFERRED
    if wait.any():  # their hits aren't counted: more than the crowd
        many = np.full(int(wait.sum()), 1 << 20, np.int64)
        yield _hits(len(many), b=rid[wait], grp=grp[wait], suffix=suffix[wait], hits=many, n=n[wait], inner=many)
    arrays = [(False, x) for x in stored_arrays(folders, place)]
    if hot is None:
        arrays += [(True, x) for x in stored_arrays(asked, place)]
    else:
        in_array = np.isin(kind, (ENTRY, STORED, MARKER))
        if not in_array.any():
            return
        own = SuffixArray.of(*(x[in_array] for x in (grp, suffix, rid, n)))
        for i, piece in _in_pieces(own):
            yield _hits(1, place, piece=[i], blob=[piece])
        arrays.append((True, own))
    asks = (kind == ENTRY) if hot is not None else (kind == PROBE)
    if not asks.any():
        return
    g, s, b, m = grp[asks], suffix[asks], rid[asks], n[asks]
    del kind, grp, rid, n, suffix, cells
    groups = np.unique(np.concatenate([np.unique(g), *(np.unique(a[0]) for _, a in arrays)]))
    code = _codes(g, s, groups)
    order = np.argsort(code)
    g, s, b, m, code = g[order], s[order], b[order], m[order], code[order]
    ranges, hits, inner, jam = [], np.zeros(len(b), np.int64), np.zeros(len(b), np.int64), np.zeros(len(b), bool)
    for is_own, array in arrays:
        c = array.codes(groups)
        lo = np.searchsorted(c, code)
        met = np.flatnonzero(c[np.minimum(lo, len(c) - 1)] == code) if len(c) else np.empty(0, np.int64)
        met = met[lo[met] < len(c)]
        hi = lo.copy()
        hi[met] = np.searchsorted(c, code[met], side="right")
        if hot is not None:
            marks = np.flatnonzero(array[3] == MARK)
            if len(marks):
                jam |= np.isin(code, c[marks])
        hits += hi - lo
        if is_own:
            inner = hi - lo
            if hot is not None:  # a lookup meets its own entry
                hi = np.where(inner == 1, lo, hi)
        ranges.append((is_own, array, lo, hi))
    if hot is not None:
        late = (jam | (hits > hot)) & (m >= 0)
        if late.any():
            yield _hits(int(late.sum()), b=b[late], grp=g[late], suffix=s[late], hits=np.where(jam[late], 1 << 20, hits[late]), n=m[late], inner=np.where(jam[late], 1 << 20, inner[late]))
        ranges = [(is_own, array, lo, np.where(late, lo, hi)) for is_own, array, lo, hi in ranges]
    for is_own, array, lo, hi in ranges:
        asking = np.flatnonzero(hi > lo)
        lo, hi = lo[asking], hi[asking]
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(lo):  # about a million hits at once
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), side="right")))
            size = hi[at:to] - lo[at:to]
            who = np.repeat(asking[at:to], size)
            hit = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[at:to], size)
            a, na, nb = array[2][hit], array[3][hit], m[who]
            near = (array[1][hit] == s[who]) & (array[0][hit] == g[who]) & (na != MARK)
            near &= ((na >= 0) & (nb >= 0) & (np.minimum(na, nb) >= similar * np.maximum(na, nb) - 1e-6)) | ((nb == WHOLE) & (na == WHOLE))
            if is_own:
                near &= a < b[who]
            if near.any():
                a, bb, nb = a[near], b[who][near], nb[near]
                w = np.where(nb == WHOLE, 100, 1).astype(np.int64)
                order = np.lexsort((a, bb))
                a, bb, nb, w = a[order], bb[order], nb[order], w[order]
                first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (bb[1:] != bb[:-1])])
                yield _hits(len(first), a=a[first], b=bb[first], weight=np.add.reduceat(w, first).astype(np.int32), own=np.full(len(first), is_own), n=np.maximum.reduceat(nb, first))
            at = to


def _build(batches: Iterator[pa.RecordBatch], asked: list[str], folders: list[str], refused: str) -> Iterator[pa.RecordBatch]:
    """The array of one range: the batch's own without refused records, and the stored arrays that are merged with it, in pieces."""
    places = [p for b in batches for p in b.column(0).to_pylist()]
    fs, root = pa_fs.FileSystem.from_uri(refused)
    out = pq.read_table(root, columns=["id"], filesystem=fs).column("id").to_numpy() if places else None
    for place in places:
        arrays = []
        for a in stored_arrays(asked, place):
            ids, index = np.unique(a[2], return_inverse=True)
            keep = ~np.isin(ids, out)[index]
            arrays.append(SuffixArray(x[keep] for x in a))
        arrays += stored_arrays(folders, place)
        if arrays:
            for i, piece in _in_pieces(SuffixArray.merged(arrays) if len(arrays) > 1 else arrays[0]):
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([i], pa.int32()), pa.array([piece], pa.binary())], names=["place", "piece", "blob"])


def _jaccard(batches: Iterator[pd.DataFrame], similar: float) -> Iterator[pd.DataFrame]:
    """The pairs whose payloads are equal or similar: all windows of one are looked up in the sorted windows of the other."""
    for pdf in batches:
        known: dict[int, np.ndarray] = {}
        keep = np.zeros(len(pdf), bool)
        for k, (a, b, x, y) in enumerate(zip(pdf["a"], pdf["b"], pdf["pa"], pdf["pb"])):
            for i, p in ((a, x), (b, y)):
                if i not in known:
                    known[i] = windows(bytes(p))
            u, v = known[a], known[b]
            if not len(u) or not len(v):
                keep[k] = x == y
                continue
            common = int((u[np.minimum(np.searchsorted(u, v), len(u) - 1)] == v).sum())
            keep[k] = common > 0 and common >= similar * (len(u) + len(v) - common)
        yield pdf.loc[keep, ["grp", "a", "b", "own"]]


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """``_refused`` for the edges of one group, in one pass over them."""
    ids, place = np.unique(np.concatenate((pdf["a"], pdf["b"])), return_inverse=True)
    a, b, own = place[: len(pdf)], place[len(pdf) :], pdf["own"].to_numpy(bool)
    out = np.zeros(len(ids), bool)
    out[b[~own]] = True
    order = np.lexsort((a, b))
    order = order[own[order]]
    # ids come in order of arrival, so all that stands before is decided
    for i, j in zip(a[order].tolist(), b[order].tolist()):
        if not out[i]:
            out[j] = True
    return pd.DataFrame({"id": ids[out]})


def _refused(edges: DataFrame, local: int = 1_000_000, max_rounds: int = 100_000) -> DataFrame:
    """Ids that an accepted earlier record refuses, of written edges (grp, a earlier, b, own); ids within the batch are in
    order of arrival, an ``a`` that isn't ``own`` is a stored record and accepted.

    Groups of at most ``local`` edges are settled in one task each. In larger ones it goes round by round: whoever has no
    undecided earlier neighbour is accepted, and its later neighbours are refused.
    """
    if edges.count() <= local:
        return cut(edges.groupBy("grp").applyInPandas(_settle, "id bigint"), "refused")
    large = cut(edges.groupBy("grp").count().where(F.col("count") > local).select("grp"), "large")
    out = cut(edges.join(large, "grp", "left_anti").groupBy("grp").applyInPandas(_settle, "id bigint"), "refused")
    left, drops = edges.join(large, "grp", "left_semi"), []
    gone = cut(left.where("not own").select(F.col("b").alias("id")).distinct(), "gone")
    out = out.unionByName(gone)
    left = left.where("own").select("a", "b").join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
    for _ in range(max_rounds):
        heads = left.select(F.col("a").alias("id")).distinct().join(left.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        heads = Cut(heads, "heads")
        beaten = Cut(left.join(heads.df.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "beaten")
        if heads.df.isEmpty():
            return cut(out, "refused")
        out = out.unionByName(beaten.df)
        done = heads.df.unionByName(beaten.df)
        rest = Cut(left.join(done.withColumnRenamed("id", "a"), "a", "left_anti").join(beaten.df.withColumnRenamed("id", "b"), "b", "left_anti"), "edges")
        for x in drops:
            x.drop()
        drops, left = [rest, heads], rest.df
    raise RuntimeError(f"records are undecided after {max_rounds} rounds")


class _Asked(Cut):
    """What a search tells: hits under place -1, and the batch's own arrays by place, which tasks open by themselves."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{scratch_root(self.spark)}/asked-{uuid.uuid4().hex[:12]}"
        df.write.partitionBy("place").parquet(self.path)
        self.df = self.spark.read.schema(HITS).parquet(self.path).where("place = -1").drop("place", "piece", "blob")


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id isn't in a written table of ids; the rows only move where that table is large."""
    return rows.join(F.broadcast(ids) if fits(ids, 1_000_000) else ids, "id", "left_anti")


class History:
    """Accepted records in a folder, and what asks them: one ``add`` per batch, in order.

    In the folder: suffix arrays of the accepted records, partitioned by suffix (``segment-...``), their payloads
    (``accepted/...``), the pairs told (``pairs/...``) and a list of the current parts (``state-...``). Arrays are never
    changed: each batch writes one, merged with the arrays of as many batches before as make their number a binary counter,
    so there are logarithmically many. ``add`` reads those arrays and one batch; of earlier batches only accepted
    payloads that became candidates leave their scan. Everything is written by Spark jobs, and the list last, so a batch that fails may be
    added again.
    """

    def __init__(self, spark: SparkSession, folder: str, *, parts: int | None = None, similar: float = 0.70, cover: int = COVERAGE, hot: int = 64, few: int = 20_000_000, crowd: int = CROWD):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.similar, self.cover, self.hot, self.few, self.crowd = similar, cover, hot, few, crowd
        self.state = {"calls": 0, "parts": parts, "order": None, "segments": [], "accepted": [], "pairs": []}
        p, fs = path(spark, f"{self.folder}/state-*")
        found = sorted(s.getPath().getName() for s in fs.globStatus(p) or ())
        if found:
            self.state = json.loads(spark.read.text(f"{self.folder}/{found[-1]}", wholetext=True).first()[0])
            self.costs = np.frombuffer(spark.read.format("binaryFile").load(f"{self.folder}/{self.state['order']}").first()["content"], np.uint8)

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def accepted(self) -> DataFrame | None:
        """grp, id, payload of all accepted records."""
        return self.spark.read.schema("grp bigint, id bigint, payload binary").parquet(*map(self._path, self.state["accepted"])) if self.state["accepted"] else None

    def pairs(self) -> DataFrame:
        """accepted, repeated of all batches added so far."""
        schema = "accepted bigint, repeated bigint"
        return self.spark.read.schema(schema).parquet(*map(self._path, self.state["pairs"])) if self.state["pairs"] else self.spark.createDataFrame([], schema)

    def _entries(self, rows: DataFrame) -> DataFrame:
        parts, crowd, costs, similar, cover = self.state["parts"], self.crowd, self.costs, self.similar, self.cover
        return rows.select("grp", "id", "c1", "payload").mapInArrow(lambda it: _spread(it, parts, crowd, costs, similar, cover), ENTRIES)

    def _cut(self, df: DataFrame, name: str) -> DataFrame:
        """A table that is needed until the call ends."""
        self.held.append(Cut(df, name))
        return self.held[-1].df

    def _drop(self) -> None:
        for x in self.held:
            x.drop()
        self.held = []

    def _uri(self, name: str) -> str:
        """A path that tasks can open by themselves, on whatever file system it is."""
        p, fs = path(self.spark, name)
        whole = fs.makeQualified(p).toString()
        return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole

    def _folders(self, names: list[str]) -> list[str]:
        return [self._uri(self._path(n)) for n in names]

    def _asked(self, rows: DataFrame, hot: int | None, asked: list[str]) -> DataFrame:
        parts, similar, folders = self.state["parts"], self.similar, self._folders(self.state["segments"])
        return rows.repartitionById(parts, "place").mapInArrow(lambda it: _search(it, hot, similar, folders, asked), HITS)

    def add(self, sketch: DataFrame, depth: int = 2) -> None:
        """Decide on one batch (columns of ``sketches``; its records come in order of id, ids never repeat) and take in what is
        accepted. ``sketch`` must be a written table, it is read several times."""
        if self.state["parts"] is None:
            self.state["parts"] = shuffle_partitions(sketch, 16 << 20)
        if self.state["order"] is None:
            self._begin(rarities(sketch))
        cls = ["grp", "c1", "c2"]
        self.held: list[Cut] = []
        first = self._cut(sketch.groupBy(*cls).agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
        # a class of equal payloads is asked once, by its first record
        many = first.where("copies > 1").select(*cls, "rep")
        spare = self._cut(bounded_join(sketch.select(*cls, "id"), many, cls, rows=200_000).where("id <> rep").select("id"), "spare")
        reps = _without(sketch, spare)
        asked = _Asked(self._asked(self._entries(reps), self.hot, []))
        self.held.append(asked)
        own = [self._uri(asked.path)]
        hits = asked.df
        # of two similar records so many of the first windows in both agree, see prefixes
        need = lambda n: F.least(F.lit(self.cover), F.ceil(F.lit(self.similar) * n - 1e-6))
        busy = hits.where("a is null")
        counted = hits.where("a is not null").groupBy("a", "b").agg(F.sum("weight").alias("k"), F.max("n").alias("nb"), F.first("own").alias("own"))
        if busy.isEmpty():
            pairs = counted.where(F.col("k") >= need(F.col("nb"))).select("a", "b", "own")
        else:
            h = self._cut(busy.groupBy("b").agg(F.count("*").alias("h"), F.first("n").alias("nb"), F.array_sort(F.collect_list(F.struct("hits", "suffix", "grp", "inner"))).alias("probes")), "busy")
            pairs = counted.join(h.select("b", "h"), "b", "left").where(F.col("k") + F.coalesce("h", F.lit(0)) >= need(F.col("nb"))).select("a", "b", "own")
            # b may share deferred windows only: its rarest ones, all but cover - 1, are looked up one by one
            rarest = F.slice("probes", F.lit(1), (F.col("h") - need(F.col("nb")) + 1).cast("int"))
            waiting = self._cut(h.where(F.col("h") >= need(F.col("nb"))).select("b", "nb", F.explode(rarest).alias("p")).select("b", "nb", "p.*"), "waiting")
            total = waiting.agg(F.sum("inner").alias("s"), F.countDistinct("b").alias("c")).first()
            if depth and (total["s"] or 0) > self.few:
                self._drop()
                return self._in_parts(sketch, min(32, -(-total["s"] // self.few) + 1), depth - 1)
            if total["c"]:
                parts = self.state["parts"]
                salted = waiting.select("b", "grp", "suffix", F.col("nb").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS))).alias("salt"))
                probes = salted.mapInArrow(lambda it: _probes(it, parts), ENTRIES)
                pairs = pairs.unionByName(self._asked(probes, None, own).where("a is not null").select("a", "b", "own")).distinct()
        self._take_in(sketch, first, spare, own, self._verified(pairs, sketch))

    def _verified(self, pairs: DataFrame, sketch: DataFrame) -> DataFrame:
        """The pairs whose payloads are similar. Of the stored payloads only those of the pairs leave their scan."""
        pairs = self._cut(pairs, "pairs")
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        bodies = sketch.select("id", "grp", "payload")
        if self.state["accepted"]:
            bodies = bodies.unionByName(self.accepted().select("id", "grp", "payload"))
        bodies = self._cut(bounded_join(bodies, wanted, ["id"], rows=500_000, salts=1), "bodies")
        both = pairs.join(bodies.select(F.col("id").alias("a"), "grp", F.col("payload").alias("pa")), "a").join(bodies.select(F.col("id").alias("b"), "grp", F.col("payload").alias("pb")), ["b", "grp"])
        similar = self.similar
        return self._cut(both.select("grp", "a", "b", "own", "pa", "pb").mapInPandas(lambda it: _jaccard(it, similar), "grp bigint, a bigint, b bigint, own boolean"), "edges")

    def _in_parts(self, sketch: DataFrame, parts: int, depth: int) -> None:
        """A batch with too many near copies is taken in parts, in order: each meets what the parts before left accepted."""
        edges = sketch.approxQuantile("id", [i / parts for i in range(1, parts)], 0.001)
        bounds = [None, *sorted({int(x) for x in edges}), None]
        for lo, hi in zip(bounds, bounds[1:]):
            part = sketch
            if lo is not None:
                part = part.where(F.col("id") > lo)
            if hi is not None:
                part = part.where(F.col("id") <= hi)
            part = cut(part, "part")
            if not part.isEmpty():
                self.add(part, depth if len(bounds) > 2 else 0)

    def _take_in(self, sketch: DataFrame, first: DataFrame, spare: DataFrame, asked: list[str], edges: DataFrame) -> None:
        call, state = self.state["calls"], json.loads(json.dumps(self.state))
        self.held.append(Cut(_refused(edges), "refused"))
        refused, out_ids = self.held[-1].df, self._uri(self.held[-1].path)
        cls = ["grp", "c1", "c2"]
        out = F.lit(True).alias("out")
        judged = edges.join(refused.select(F.col("id").alias("a"), out), "a", "left").join(refused.select(F.col("id").alias("b"), F.lit(True).alias("out_b")), "b", "left")
        none = F.lit(None).cast("bigint").alias("above")
        targets = judged.where("out is null").select(F.col("a").alias("accepted"), F.col("b").alias("rep"), none)
        # a record accepted after the first of a refused class still refuses the copies that come later
        back = judged.where("out and out_b is null").select(F.col("b").alias("accepted"), F.col("a").alias("rep"), F.col("b").alias("above"))
        own = first.where("copies > 1").join(refused.withColumnRenamed("id", "rep"), "rep", "left_anti").select(F.col("rep").alias("accepted"), "rep", none)
        named = first.select("rep", "copies", *cls).join(targets.unionByName(back).unionByName(own), "rep")
        # most classes have one record; the members of the others are found by a join that a large class can't burden
        alone = named.where("copies = 1").select("accepted", "above", F.col("rep").alias("id"))
        members = bounded_join(sketch.select(*cls, "id"), named.where("copies > 1").select("accepted", "above", *cls), cls, rows=200_000).select("accepted", "above", "id")
        members = alone.unionByName(members).where("above is null or id > above")
        tag = f"{call:06d}-{uuid.uuid4().hex[:6]}"
        members.where("accepted <> id").select("accepted", F.col("id").alias("repeated")).write.parquet(self._path(f"pairs/{tag}"))
        gone = self._cut(spare.unionByName(refused), "gone")
        _without(sketch.select("grp", "id", "payload"), gone).write.parquet(self._path(f"accepted/{tag}"))
        # as a binary counter: a number that ends in k ones before has k arrays to merge
        merge = len(bin(call + 1)) - len(bin(call + 1).rstrip("0"))
        old = state["segments"][len(state["segments"]) - merge :] if merge else []
        parts, folders = self.state["parts"], self._folders(old)
        every = self.spark.range(0, parts, 1, parts).select(F.col("id").cast("int").alias("place"))
        every.mapInArrow(lambda it: _build(it, asked, folders, out_ids), "place int, piece int, blob binary").write.partitionBy("place").parquet(self._path(f"segment-{tag}"))
        state["segments"] = [s for s in state["segments"] if s not in old] + [f"segment-{tag}"]
        state["accepted"].append(f"accepted/{tag}")
        state["pairs"].append(f"pairs/{tag}")
        state["calls"] = call + 1
        self._publish(state)
        self._drop()
        for s in old:
            remove(self.spark, self._path(s))

    def _begin(self, costs: np.ndarray) -> None:
        """The order of windows is fixed by the first batch and kept: it must be the same for all."""
        name = f"order-{uuid.uuid4().hex[:8]}"
        out = path(self.spark, self._path(name))[1].create(path(self.spark, self._path(name))[0])
        out.write(bytearray(costs.tobytes()))
        out.close()
        self.costs, self.state["order"] = costs, name

    def _publish(self, state: dict) -> None:
        """The list of parts, under a name above all before, made by one rename."""
        source, fs = path(self.spark, self._path(f"draft-{uuid.uuid4().hex[:8]}"))
        out = fs.create(source)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(source, path(self.spark, self._path(f"state-{state['calls']:06d}"))[0]):
            raise OSError("the state of the history could not be published")
        self.state = state


def _probes(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Deferred lookups at all places where entries of their suffix may lie."""
    for b in batches:
        if b.num_rows:
            grp, suffix, salt = (b.column(n).to_numpy(zero_copy_only=False) for n in ("grp", "suffix", "salt"))
            yield _rows(_placed(grp, suffix, salt, parts), PROBE, grp, b.column("b").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False), suffix)


def repeats(records: DataFrame, *, group: str, batch: str, record_id: str, payload: str, folder: str | None = None, **how) -> DataFrame:
    """Pairs of an accepted record and a later, not accepted one that are identical or similar.

    Within each group records come in order of (batch, record_id); one is accepted unless
    some record accepted before is identical or similar: at least the share ``similar`` of
    the distinct 8-byte windows of either is in both. Payloads under 8 bytes, the empty one
    included, are similar to their copies only. Rows without payload, group, batch or id
    are left out; a record_id must be unique; an empty table gives no rows.

    Columns: accepted, repeated (record ids).

    The records are read once and laid by batch, and added to a ``History`` in ``folder`` (by default in the
    session's scratch folder, begun anew). Batches that are there together are added in steps, each with at least as many batches as
    all before, so that a first load takes logarithmically many; later batches go to ``History.add`` one by one.

    Identical payloads of a batch are one class, represented by its first record. Of each class all windows are put into
    one order, rare ones first, and the first n - ceil(0.70 n) + ``cover`` of its n windows enter an array, by a hash:
    two records at or above 0.70 always agree in ``cover`` of these (in all common ones if they are fewer), so none is missed,
    see ``prefixes``. The arrays are sorted and immutable, one per batch, merged logarithmically, and partitioned
    by window, so one group may hold any share of the rows. A batch's windows are looked up by binary
    search; the hits per pair are the coverage. Lookups with more than ``hot`` hits are deferred: a record can only be missed if all its shared
    windows are of that kind, so only records with at least ``cover`` such lookups take them up, the rarest first. A batch whose
    records are deferred for each other over ``few`` times is taken in parts, so that near copies meet the few accepted of their
    kind and not each other. Coverage only selects candidates; all windows of both payloads decide. The result never depends on
    ``hot``, ``few``, ``crowd`` or the parts.
    """
    spark = records.sparkSession
    laid = f"{scratch_root(spark)}/sketch-{uuid.uuid4().hex[:12]}"
    made = sketches(records, group=group, batch=batch, record_id=record_id, payload=payload)
    made.write.partitionBy("batch").parquet(laid)
    if not path(spark, laid)[1].globStatus(path(spark, f"{laid}/batch=*")[0]):
        return spark.createDataFrame([], "accepted bigint, repeated bigint")
    every = spark.read.schema(SKETCH).parquet(laid)
    history = History(spark, folder or f"{scratch_root(spark)}/history-{uuid.uuid4().hex[:12]}", parts=shuffle_partitions(every, 16 << 20), **how)
    batches = every.groupBy("batch").agg(F.min("id").alias("low"), F.max("id").alias("high")).orderBy("batch").collect()  # as many as batches
    # (batch, id) as one number orders the records of several batches; where it doesn't fit, batches go one by one
    fits = batches[0]["batch"] >= 0 and batches[-1]["batch"] < 1 << 14 and all(r["low"] >= 0 and r["high"] < 1 << 48 for r in batches)
    order = F.shiftleft(F.col("batch").cast("bigint"), 48) + F.col("id") if fits else F.col("id")
    at = 0
    while at < len(batches):
        step = batches[at : at + (max(1, at) if fits else 1)]
        history.add(every.where(F.col("batch").between(step[0]["batch"], step[-1]["batch"])).withColumn("id", order).drop("batch"))
        at += len(step)
    if not fits:
        return history.pairs()
    bare = lambda c: F.col(c).bitwiseAND(F.lit((1 << 48) - 1)).alias(c)
    return history.pairs().select(bare("accepted"), bare("repeated"))
