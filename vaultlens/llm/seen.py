"""Has this key been seen before: partitioned cuckoo tables of short fingerprints."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import hash_pair
from ..plans.sizing import shuffle_partitions
from ..session import path, scratch_root

SLOTS = 4
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class CuckooTable:
    """Fingerprints in buckets of four; a key may lie in either of two buckets."""

    def __init__(self, buckets: int, bits: int = 32, seed: int = 1):
        self.mask, self.bits, self.used = np.uint64(buckets - 1), np.uint64(bits), 0
        self.cells = np.zeros((buckets, SLOTS), np.uint16 if bits <= 16 else np.uint32)
        self.stash = np.empty((0, 2), np.uint64)  # bucket and fingerprint of what found no cell
        self.dice = np.random.default_rng(seed)

    def _marks(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = keys.astype(np.uint64) * M1
        h ^= h >> np.uint64(32)
        h *= M2
        h ^= h >> np.uint64(29)
        fp = h >> (np.uint64(64) - self.bits)
        return np.where(fp == 0, np.uint64(1), fp), h & self.mask

    def _other(self, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        h = fp * M2
        return (bucket ^ (h ^ (h >> np.uint64(31)))) & self.mask

    def _stashed(self, fp: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Stash rows that may hold each key: a matrix, as the stash is small."""
        return (self.stash[None, :, 1] == fp[:, None]) & ((self.stash[None, :, 0] == one[:, None]) | (self.stash[None, :, 0] == two[:, None]))

    def has(self, keys: np.ndarray) -> np.ndarray:
        fp, one = self._marks(keys)
        two = self._other(fp, one)
        want = fp.astype(self.cells.dtype)[:, None]
        hit = (self.cells[one] == want).any(1) | (self.cells[two] == want).any(1)
        return hit | self._stashed(fp, one, two).any(1) if len(self.stash) else hit

    def add(self, keys: np.ndarray, kicks: int = 200) -> None:
        """Insert; keys must be distinct. What finds no cell after so many kicks goes to a small stash."""
        fp, bucket = self._marks(keys)
        for turn in range(kicks):
            fp, bucket = self._settle(fp, bucket)
            if not len(fp):
                return
            bucket = self._other(fp, bucket)
            if turn:  # both buckets are full: push out one fingerprint per bucket
                _, first = np.unique(bucket, return_index=True)
                full = (self.cells[bucket[first]] != 0).all(1)
                first = first[full]
                slot = self.dice.integers(0, SLOTS, len(first))
                b = bucket[first]
                out = self.cells[b, slot].astype(np.uint64)
                self.cells[b, slot] = fp[first].astype(self.cells.dtype)
                fp[first] = out
                bucket[first] = self._other(out, b)
        self.stash = np.concatenate((self.stash, np.stack((bucket, fp), 1)))
        self.used += len(fp)

    def _settle(self, fp: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fill free cells; returns what found none."""
        order = np.argsort(bucket, kind="stable")
        fp, bucket = fp[order], bucket[order]
        first = np.r_[True, bucket[1:] != bucket[:-1]]
        rank = np.arange(len(bucket)) - np.maximum.accumulate(np.where(first, np.arange(len(bucket)), 0))
        taken = self.cells[bucket] != 0
        fits = rank < SLOTS - taken.sum(1)
        free = np.argsort(taken, axis=1, kind="stable")[fits, rank[fits]]
        self.cells[bucket[fits], free] = fp[fits].astype(self.cells.dtype)
        self.used += int(fits.sum())
        return fp[~fits], bucket[~fits]

    def remove(self, keys: np.ndarray) -> np.ndarray:
        """Delete one fingerprint per key; only keys that were added may be given. Tells which were there."""
        fp, one = self._marks(keys)
        two = self._other(fp, one)
        want = fp.astype(self.cells.dtype)
        done = np.zeros(len(fp), bool)
        for i in range(len(fp)):
            for b in (one[i], two[i]):
                at = np.flatnonzero(self.cells[b] == want[i])
                if len(at):
                    self.cells[b, at[0]] = 0
                    done[i] = True
                    break
            if not done[i] and len(self.stash):
                at = np.flatnonzero(self._stashed(fp[i : i + 1], one[i : i + 1], two[i : i + 1])[0])
                if len(at):
                    self.stash = np.delete(self.stash, at[0], 0)
                    done[i] = True
        self.used -= int(done.sum())
        return done


class GrowingCuckoo:
    """Cuckoo tables that grow: when the newest reaches ``load`` of its cells it is closed, and one twice as large follows.

    Older tables never take keys again, so nothing needs the keys again. With fingerprints below 32 bits each further
    table has one bit more, so that the sum of the tables' error rates stays bounded.

    Deletion is safe. A key that a closed table claims by mistake when it is added goes to an exact list
    (about 8 / 2**bits of the keys). So no table older than the one that holds a key claims it, and a key is removed
    from the oldest table that claims it; equal fingerprints of one bucket pair can stand for each other. Only keys
    that were added may be removed: of a new key claimed wrongly, and so not added, a removal would hit another's fingerprint.

    Memory at 32 bits: 4 bytes a cell, of which 0.9 are used in closed tables: 4.4 bytes a key, and up to 9.8 just
    after a table was opened.
    """

    def __init__(self, buckets: int = 1024, bits: int = 32, load: float = 0.9):
        self.bits, self.limit = bits, load
        self.tables = [CuckooTable(buckets, bits)]
        self.exact = np.empty(0, np.uint64)

    def _claimed(self, keys: np.ndarray, tables: list[CuckooTable]) -> np.ndarray:
        hit = np.zeros(len(keys), bool)
        for t in tables:
            hit |= t.has(keys)
        return hit

    def has(self, keys: np.ndarray) -> np.ndarray:
        hit = self._claimed(keys, self.tables)
        return hit | np.isin(keys.astype(np.uint64), self.exact) if len(self.exact) else hit

    def add(self, keys: np.ndarray) -> None:
        """Insert distinct keys."""
        while len(keys):
            t = self.tables[-1]
            room = max(0, int(self.limit * t.cells.size) - t.used)
            now, keys = keys[:room], keys[room:]
            doubtful = self._claimed(now, self.tables[:-1])
            if doubtful.any():
                self.exact = np.concatenate((self.exact, now[doubtful].astype(np.uint64)))
            t.add(now[~doubtful])
            if len(keys):
                self.tables.append(CuckooTable(2 * len(t.cells), min(32, self.bits + len(self.tables)), len(self.tables) + 1))

    def remove(self, keys: np.ndarray) -> np.ndarray:
        """Delete distinct keys that were added; tells which were there."""
        keys = keys.astype(np.uint64)
        done = np.isin(keys, self.exact)
        self.exact = self.exact[~np.isin(self.exact, keys)]
        for t in self.tables:
            rest = np.flatnonzero(~done)
            rest = rest[t.has(keys[rest])]
            done[rest] = t.remove(keys[rest])
        return done

    @property
    def nbytes(self) -> int:
        return self.exact.nbytes + sum(t.cells.nbytes + t.stash.nbytes for t in self.tables)

    def dump(self) -> bytes:
        out = io.BytesIO()
        parts = {f"{n}{i}": x for i, t in enumerate(self.tables) for n, x in (("cells", t.cells), ("stash", t.stash))}
        np.savez(out, exact=self.exact, bits=np.array([self.bits, *(int(t.bits) for t in self.tables)]), used=np.array([t.used for t in self.tables]), limit=np.array([self.limit]), **parts)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> GrowingCuckoo:
        with np.load(io.BytesIO(raw), allow_pickle=False) as f:
            bits = f["bits"].tolist()
            out = cls(1, bits[0], float(f["limit"][0]))
            out.exact, out.tables = f["exact"], []
            for i, (b, used) in enumerate(zip(bits[1:], f["used"].tolist())):
                cells = f[f"cells{i}"]
                t = CuckooTable(1, b, i + 1)
                t.mask, t.cells, t.stash, t.used = np.uint64(len(cells) - 1), cells, f[f"stash{i}"], used
                out.tables.append(t)
        return out


def _fold(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Pre-aggregation before the shuffle: of the rows of one batch with the same key only
    the earliest asks the tables; the others are repeats for certain and are spread by id."""
    for b in batches:
        if not b.num_rows:
            continue
        k1, k2, o1, o2, rid = (b.column(n).to_numpy(zero_copy_only=False) for n in ("k1", "k2", "o1", "o2", "record_id"))
        order = np.lexsort((o2, o1, k2, k1))
        new = np.r_[True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])]
        sure = np.empty(len(k1), bool)
        sure[order] = ~new
        where = np.where(sure, rid.astype(np.uint64) * M2, k2.astype(np.uint64) * M1) >> np.uint64(33)
        yield pa.RecordBatch.from_arrays([pa.array((where % np.uint64(parts)).astype(np.int32)), pa.array(sure), *(b.column(n) for n in ("stream_name", "record_id", "o1", "o2", "k1", "k2"))], names=["place", "sure", "stream_name", "record_id", "o1", "o2", "k1", "k2"])


ROWS = "stream_name string, record_id bigint, o1 bigint, o2 bigint, k1 bigint, k2 bigint"
PIECE = 16 << 20


def _ask(batches: Iterator[pa.RecordBatch], bits: int, parts: int, forget: bool) -> Iterator[pa.RecordBatch]:
    """One partition in order of arrival, after the pieces of its tables: tells rows whose key the tables claim to know, and
    at the end the tables (piece, blob). With ``forget`` the keys are removed, and those are told that were there."""
    known, pieces, place = None, [], None
    names = ["place", "piece", "blob", "sure", "stream_name", "record_id", "o1", "o2", "k1", "k2"]
    for b in batches:
        if not b.num_rows:
            continue
        place = b.column("place")[0].as_py()
        old = b.column("blob").is_valid().to_numpy(zero_copy_only=False)
        if old.any():
            pieces += b.column("blob").filter(pa.array(old)).to_pylist()
            b = b.filter(pa.array(~old))
            if not b.num_rows:
                continue
        if known is None:
            known, pieces = GrowingCuckoo.load(b"".join(pieces)) if pieces else GrowingCuckoo(bits=bits), []
        sure = b.column("sure").to_numpy(zero_copy_only=False)
        flag = sure.copy()
        asks = np.flatnonzero(~sure)
        keys = b.column("k1").to_numpy(zero_copy_only=False)[asks].astype(np.uint64)
        _, first = np.unique(keys, return_index=True)
        again = np.full(len(keys), not forget)
        if forget:
            again[first] = known.remove(keys[first])
        else:
            again[first] = known.has(keys[first])
            known.add(keys[first[~again[first]]])
        flag[asks] = again
        at = pa.array(np.flatnonzero(flag))
        if len(at):
            yield b.take(at).select(names)
    if place is None:
        return
    raw = known.dump() if known is not None else b"".join(pieces)
    for i in range(0, len(raw), PIECE):
        cells = {"place": pa.array([place], pa.int32()), "piece": pa.array([i // PIECE], pa.int32()), "blob": pa.array([raw[i : i + PIECE]], pa.binary()), "sure": pa.nulls(1, pa.bool_()), "stream_name": pa.nulls(1, pa.string())}
        yield pa.RecordBatch.from_arrays([cells.get(n, pa.nulls(1, pa.int64())) for n in names], names=names)


class SeenStore:
    """Cuckoo tables kept in a folder, one set per partition of the keys, as a new version with every call.

    ``ask`` decides for one batch of keys and remembers them; ``forget`` deletes keys. Each reads the tables of the
    last complete version and the given keys, nothing of earlier batches. The number of partitions is fixed when
    the folder is begun, as the tables can't be split without the keys.
    Writes go through Spark, so a lost executor costs a repeated task; a version that isn't complete is ignored.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int | None = None, bits: int = 32):
        self.spark, self.folder, self.bits, self.version, self.parts = spark, folder.rstrip("/"), bits, 0, parts
        held = path(spark, f"{self.folder}/v*-p*/_SUCCESS")
        for status in held[1].globStatus(held[0]) or ():
            v, p = status.getPath().getParent().getName()[1:].split("-p")
            if int(v) > self.version:
                self.version, self.parts = int(v), int(p)

    def _tables(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/v{self.version}-p{self.parts}").where("piece is not null") if self.version else None

    def _run(self, keys: DataFrame, forget: bool) -> DataFrame:
        if self.parts is None:
            self.parts = shuffle_partitions(keys)
        parts, bits = self.parts, self.bits
        rows = keys.where(F.col("k1").isNotNull()).select("stream_name", "record_id", F.coalesce(F.col("o1"), F.lit(-(1 << 62))).alias("o1"), "o2", "k1", "k2")
        folded = rows.mapInArrow(lambda it: _fold(it, parts), f"place int, sure boolean, {ROWS}").withColumn("piece", F.lit(None).cast("int")).withColumn("blob", F.lit(None).cast("binary"))
        old = self._tables()
        if old is not None:
            folded = folded.unionByName(old)
        placed = folded.repartitionById(parts, "place").sortWithinPartitions(F.col("piece").asc_nulls_last(), "o1", "o2")
        self.version += 1
        target = f"{self.folder}/v{self.version}-p{parts}"
        placed.mapInArrow(lambda it: _ask(it, bits, parts, forget), f"place int, piece int, blob binary, sure boolean, {ROWS}").write.mode("overwrite").parquet(target)
        return self.spark.read.parquet(target).where("piece is null").select("sure", *[f.split()[0] for f in ROWS.split(", ")])

    def ask(self, keys: DataFrame) -> DataFrame:
        """Rows whose key the tables claim to have seen before, in this batch or an earlier one; remembers all keys.

        ``keys``: stream_name, record_id bigint, o1, o2 bigint (order of arrival), k1, k2 bigint
        (two hashes of the key). Rows with null k1 are left out. ``sure`` marks
        repeats within one batch of the scan. No row with an earlier key is ever missed;
        about 8 / 2**bits of the new keys per table are claimed wrongly: at 32 bits and 20 tables 4 in 100 million.
        """
        return self._run(keys, False)

    def forget(self, keys: DataFrame) -> DataFrame:
        """Removes keys that were added before; tells the rows whose key was there."""
        return self._run(keys, True)


def claims(keys: DataFrame, bits: int = 32) -> DataFrame:
    """``SeenStore.ask`` for all keys at once, with tables in the session's scratch folder."""
    return SeenStore(keys.sparkSession, f"{scratch_root(keys.sparkSession)}/seen-{uuid.uuid4().hex[:12]}", bits=bits).ask(keys)


def confirmed(claimed: DataFrame, keys: DataFrame) -> DataFrame:
    """Exact check of the claims: a claim is right iff its row isn't the earliest of its key.

    The earliest row of each key comes from an aggregate with map-side combine, so a key with a
    third of all rows costs one row per map task. Adds the column right.
    """
    first = keys.where(F.col("k1").isNotNull()).groupBy("k1", "k2").agg(F.min(F.struct(F.coalesce(F.col("o1"), F.lit(-(1 << 62))).alias("o1"), "o2")).alias("first"))
    open_ = claimed.where("not sure").join(first, ["k1", "k2"]).select("stream_name", "record_id", (F.struct("o1", "o2") > F.col("first")).alias("right"))
    return claimed.where("sure").select("stream_name", "record_id", F.lit(True).alias("right")).unionByName(open_)


def keyed(df: DataFrame, stream: str, *, record_id: str, order: str, key: list) -> DataFrame:
    """Rows of one stream in the form ``claims`` takes; a row with any null key column has no key."""
    k1, k2 = hash_pair(F.lit(stream), *key)
    whole = None
    for c in key:
        whole = c.isNotNull() if whole is None else whole & c.isNotNull()
    return df.select(F.lit(stream).alias("stream_name"), F.col(record_id).cast("bigint").alias("record_id"), F.col(order).cast("bigint").alias("o1"), F.col(record_id).cast("bigint").alias("o2"), F.when(whole, k1).alias("k1"), F.when(whole, k2).alias("k2"))


def seen_before(keys: DataFrame, bits: int = 32) -> DataFrame:
    """stream_name, record_id of every row whose key is in an earlier row, as the cuckoo tables decide.

    Order is (o1, o2), a null o1 comes first. Null keys never occur. An empty table gives no rows. The tables' wrong
    answers are told by ``audit``.
    """
    return claims(keys, bits).select("stream_name", "record_id")


def audit(keys: DataFrame, bits: int = 32) -> DataFrame:
    """Per stream: rows with a key, claims, wrong claims, and wrong claims per new key; found by an exact count."""
    judged = confirmed(claims(keys, bits), keys).groupBy("stream_name").agg(F.count("*").alias("n_claims"), F.count(F.when(~F.col("right"), 1)).alias("n_wrong"))
    total = keys.where(F.col("k1").isNotNull()).groupBy("stream_name").agg(F.count("*").alias("n_rows"))
    new = F.col("n_rows") - F.col("n_claims") + F.col("n_wrong")
    return total.join(judged, "stream_name", "left").na.fill(0, ["n_claims", "n_wrong"]).select("stream_name", "n_rows", "n_claims", "n_wrong", F.coalesce(F.col("n_wrong") / F.nullif(new, F.lit(0)), F.lit(0.0)).alias("wrong_rate"))
