"""Sizes of texts in tokens of a public tokenizer, whose rank file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default rank file of a byte-level BPE; any file of lines "base64 rank" will do.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary splits text before merging. Fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str, split: str = SPLIT):
    """The tokenizer of a rank file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, key: str, text: str, keep: list[str] = [], ranks: str = RANKS) -> DataFrame:  # noqa: B006
    """(key, *keep, tokens): the number of tokens of each whole text; null texts have no row, empty ones have 0."""
    given = texts.select(F.col(key).alias("key"), *keep, F.col(text).alias("text")).filter(F.col("text").isNotNull())
    kinds = dict(given.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(ranks).encode_ordinary
        for batch in batches:
            out = batch.drop(columns="text")
            out["tokens"] = [len(encode(x)) for x in batch["text"]]
            yield out

    columns = ", ".join(f"`{c}` {kinds[c]}" for c in ["key", *keep])
    return given.mapInPandas(run, f"{columns}, tokens bigint")
