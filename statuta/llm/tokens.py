"""Sizes of texts in tokens of a public byte-level BPE vocabulary, read from a given path."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenization of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict = {}


def encoding(path: str = VOCABULARY):
    """The encoding of a vocabulary file, loaded once per process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def n_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of each text; 0 for null and empty texts."""

    def run(texts: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return F.pandas_udf(run, "int")(text)
