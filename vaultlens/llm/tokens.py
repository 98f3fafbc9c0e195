"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
_ENCODERS: dict = {}


def encoder(vocabulary: str = VOCABULARY):
    """The tiktoken encoder of a rank file: a name that the installed ``public_tokenizers`` knows, or a path."""
    if vocabulary not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def _count(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary).encode_ordinary
    for b in batches:
        n = pa.array([len(encode(x)) for x in b.column("_text").to_pylist()], pa.int64())
        names = [c for c in b.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), n], names=[*names, "n_tokens"])


def token_counts(docs: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and n_tokens of every row whose text isn't null (whole texts, as ordinary text)."""
    rows = docs.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    return rows.mapInArrow(lambda it: _count(it, vocabulary), f"{fields}, n_tokens bigint")
