"""Fixed and content-defined chunking, reassembly, range reads, compression and sealing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 32


def fixed_chunks(df: DataFrame, keep: list[str], data: str, size: int) -> DataFrame:
    """Pieces of ``size`` characters (of text) or bytes: chunk_no, piece. The empty value has none."""
    n = F.col("_n")
    rows = df.where(F.length(data) > 0).select(*keep, F.col(data).alias("_d"), F.length(data).alias("_n"))
    return rows.select(*keep, "_d", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("chunk_no")).select(*keep, "chunk_no", F.substring("_d", F.col("chunk_no") * size + 1, F.lit(size)).alias("piece"))


def rolling_hashes(data: np.ndarray, _held: dict = {}) -> np.ndarray:  # noqa: B006
    """Hash of the last ``WINDOW`` bytes at each position: sum of 2^age times a random number per byte value."""
    if "table" not in _held:
        _held["table"] = np.random.default_rng(20_24).integers(0, 2**64, 256, dtype=np.uint64)
    mixed = _held["table"][data]
    out = np.zeros(len(data), np.uint64)
    for age in range(min(WINDOW, len(data))):
        out[age:] += mixed[: len(data) - age] << np.uint64(age)
    return out


def cut_points(data: bytes, least: int = 16 << 10, average: int = 64 << 10, most: int = 256 << 10) -> list[int]:
    """Ends of content-defined chunks. A cut needs more hash bits before the average than after it
    (normalised chunking); none lies under ``least`` bytes, none is later than ``most``. Empty data has no chunk."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = rolling_hashes(np.frombuffer(data, np.uint8))
    bits = int(average).bit_length() - 1
    top = lambda k: np.flatnonzero(h >> np.uint64(64 - k) == 0) + 1
    strict, loose = top(bits + 1), top(bits - 1)
    out, at = [], 0
    while n - at > least:
        i = int(np.searchsorted(strict, at + least))
        end = int(strict[i]) if i < len(strict) and strict[i] < at + average else 0
        if not end:
            j = int(np.searchsorted(loose, at + average))
            end = min(int(loose[j]) if j < len(loose) else n, at + most, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def _cdc(batches: Iterator[pa.RecordBatch], least: int, average: int, most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: tuple[list, ...] = ([], [], [], [])
        for i, x in enumerate(b.column("_d")):
            data = x.as_py()
            at = 0
            for k, end in enumerate(cut_points(data, least, average, most)):
                for col, v in zip(rows, (i, k, at, data[at:end])):
                    col.append(v)
                at = end
        own = pa.array(rows[0], pa.int64())
        keys = [c for c in b.schema.names if c != "_d"]
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(own) for c in keys), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary())], names=[*keys, "chunk_no", "chunk_offset", "piece"])


def cdc_chunks(df: DataFrame, keep: list[str], data: str, least: int = 16 << 10, average: int = 64 << 10, most: int = 256 << 10) -> DataFrame:
    """Content-defined chunks of binary values: keep, chunk_no, chunk_offset, piece."""
    rows = df.where(F.col(data).isNotNull()).select(*keep, F.col(data).cast("binary").alias("_d"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_d")
    return rows.mapInArrow(lambda it: _cdc(it, least, average, most), f"{fields}, chunk_no int, chunk_offset bigint, piece binary")


def reassemble(chunks: DataFrame, by: list[str], order: str, piece: str) -> DataFrame:
    """Pieces of each file joined in order; a file's content is a bounded group by nature."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, piece))), lambda x: x[piece])
    joined = F.aggregate(parts, F.lit("").cast("binary"), lambda a, x: F.concat(a, x))
    return chunks.groupBy(*by).agg(joined.alias("content"))


def read_range(chunks: DataFrame, by: list[str], index: str, piece: str, size: int, offset: int, length: int) -> DataFrame:
    """Bytes [offset, offset + length) of each image of fixed chunks; chunks that aren't there read as zeros."""
    first, last = offset // size, (offset + length - 1) // size
    slots = chunks.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(first), F.lit(last))).alias(index))
    own = chunks.where(F.col(index).between(first, last)).select(*by, F.col(index).cast("int").alias(index), piece)
    zeros = F.unhex(F.repeat(F.lit("00"), F.lit(size)))
    body = slots.join(own, [*by, index], "left").withColumn(piece, F.substring(F.concat(F.coalesce(piece, F.lit("").cast("binary")), zeros), 1, size))
    whole = reassemble(body, by, index, piece)
    return whole.select(*by, F.substring("content", offset - first * size + 1, length).alias("content"))


@F.pandas_udf(T.BinaryType())
def compress_if_smaller(data: pd.Series) -> pd.Series:
    """zstd where that is strictly smaller, else null."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    packed = [None if x is None else pack(bytes(x)) for x in data]
    return pd.Series([z if z is not None and len(z) < len(x) else None for x, z in zip(data, packed)], dtype=object)


@F.pandas_udf(T.BinaryType())
def decompress(data: pd.Series) -> pd.Series:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return pd.Series([None if x is None else unpack(bytes(x)) for x in data], dtype=object)


def nonce(number: Column) -> Column:
    """12 bytes from a number that never repeats under one key."""
    return F.unhex(F.lpad(F.hex(number), 24, "0"))


def seal(data: Column, key: Column, iv: Column, aad: Column) -> Column:
    return F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), iv, aad)


def unseal(data: Column, key: Column, aad: Column) -> Column:
    return F.aes_decrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), aad)
