"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's makers cut a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    return len(_encoding(path).encode_ordinary(text))


def sized(df: DataFrame, key: str, text: str, *more: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, more columns, tokens) of every row; null texts have 0 tokens, rows with a null key are
    left out."""
    rows = df.where(F.col(key).isNotNull()).select(key, *more, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = spread(rows)
    schema = rows.drop("_text").schema.add("tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "tokens"])

    return rows.mapInArrow(count, schema)
