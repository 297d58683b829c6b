"""Sizes of texts in tokens of a public tokenizer, whose file is a parameter and lies on every executor."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.session_worker import kept

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer's vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str = TOKENIZER):
    import tiktoken

    def make():
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    return kept(path, make)


def token_sizes(df: DataFrame, keys: list[str], text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The key columns and `tokens`, 0 for a null or empty text. Whole texts are encoded, strings of special tokens as
    ordinary text; only the count leaves the worker."""
    fields = df.select(*keys).schema
    if "tokens" in keys:
        raise ValueError("a key column is named tokens")
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(sizes, pa.int64())], names=[*keys, "tokens"])

    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, out)
