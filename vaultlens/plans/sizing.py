"""Decisions that depend on measured sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


UNKNOWN = 1 << 50


def input_bytes(df: DataFrame) -> int:
    """Bytes that a plan's sources hold on disk, as the optimizer knows them from the files; 0 where it doesn't know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN)


def shuffle_partitions(df: DataFrame, unit: int = 32 << 20) -> int:
    """Partitions for operators that hold a whole range of keys in a task: one for each ``unit`` bytes of the sources,
    and at least as many as the session's shuffles have. So what a task holds doesn't grow with the data."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // unit))


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; counts no further than one more."""
    return df.limit(rows + 1).count() <= rows


def is_plain(df: DataFrame) -> bool:
    """Whether a plan only reads, filters and renames one table."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().apply(0)
    return node.children().isEmpty()


def bounded_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = 100_000, salts: int = 16) -> DataFrame:
    """Join whose small side is broadcast only if it is counted to hold at most ``rows`` rows.

    Beyond that both sides are shuffled on the keys and a salt, so that one key with a
    third of all rows of ``big`` is spread over ``salts`` tasks. ``small`` must not be
    the outer side. A small side that is more than a filtered table is written first, so that counting
    and joining it don't compute it twice.
    """
    if not is_plain(small):
        small = cut(small, "small")
    if fits(small, rows):
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    picked = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if big.schema[c].dataType.typeName() != "map"]), F.lit(salts)).cast("int"))
    return picked.join(salted, [*on, "_salt"], how).drop("_salt")
