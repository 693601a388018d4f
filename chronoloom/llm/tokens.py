"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The splitting pattern that belongs to the byte-level vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MAX_BYTES = 16_000_000
_LOADED: dict = {}


def encoder(vocabulary: str = VOCABULARY, content: bytes | None = None):
    """The tiktoken encoder of a vocabulary file (or of its content); loaded once per process."""
    if vocabulary not in _LOADED:
        import tiktoken

        if content is None:
            with open(vocabulary, "rb") as f:
                content = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _LOADED[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[vocabulary]


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text (int); 0 for empty and null texts.

    The driver reads the vocabulary (a fixed file of at most MAX_BYTES) and ships it with the job: executors need no file.
    """
    with open(vocabulary, "rb") as f:
        content = f.read(MAX_BYTES + 1)
    if len(content) > MAX_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MAX_BYTES} bytes")
    shared = SparkSession.active().sparkContext.broadcast(content)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary, shared.value)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], index=s.index, dtype="int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "long")(text)
