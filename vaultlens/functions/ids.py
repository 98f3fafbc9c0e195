"""128-bit identifiers written as text in several spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the identifier of 128 zero bits, which means "none".
NONE_HEX = "0" * 32


def id_hex(c: Column | str) -> Column:
    """The bare lower-case hex digits: without case, blanks, braces, hyphens and URN prefix."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.translate(F.lower(F.trim(c)), "{}-", "")
    return F.when(bare.startswith("urn:uuid:"), F.substring(bare, 10, 64)).otherwise(bare)


def canonical_id(c: Column | str) -> Column:
    """Lower-case 8-4-4-4-12. Text that holds no 32 digits keeps its bare form; null stays null."""
    return hyphenate(id_hex(c))


def hyphenate(h: Column) -> Column:
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.length(h) == 32, F.concat_ws("-", *parts)).otherwise(h)


def id_or_null(c: Column | str) -> Column:
    """Canonical id, with "none" (zeros, null or empty) as null."""
    h = id_hex(c)
    return F.when((h == NONE_HEX) | (h == ""), F.lit(None)).otherwise(hyphenate(h))


def hash_pair(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a tuple, in which null differs from every value.

    ``xxhash64`` skips nulls, so each column is preceded by its null flag.
    """
    flagged = [x for c in cols for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(1), *flagged), F.xxhash64(F.lit(7919), *reversed(flagged))
