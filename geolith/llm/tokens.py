"""Encoding texts with a public byte-level BPE tokenizer by a monoid tree.

A text is cut in halves down to leaves, the leaves are encoded, and neighbours are joined up the tree.  Where the
text changes from non-space to space no token of the pattern spans the place and nothing after it changes what
stands before, so tokens outside such a place on each side of a join stay.  A join re-encodes a window around the
seam, growing it until it has such a place (or the end of the part) on both sides.  Joining is associative: any
tree gives the same ids.
"""

from __future__ import annotations

import base64
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The public pattern that cuts a text before byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 1 << 14
WINDOW_CHARS = 64
_SEAM = regex.compile(r"(?<=\S)(?=\s)")


@cache
def encoder(path: str):
    """The tokenizer of a vocabulary file; special tokens are ordinary text to it."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _cut_before(text: str, lo: int, hi: int) -> int | None:
    """The first sure boundary after lo and before hi."""
    found = _SEAM.search(text, lo + 1, hi)
    return found.start() if found and lo < found.start() < hi else None


def _join(text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int], encode) -> list[int]:
    """ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
    window = WINDOW_CHARS
    while True:
        start, end = max(lo, mid - window), min(hi, mid + window)
        a = lo if start == lo else _cut_before(text, start, mid)
        b = hi if end == hi else _cut_before(text, mid, end)
        if a is not None and b is not None:
            break
        window *= 2
    gone_left, gone_right = len(encode(text[a:mid])), len(encode(text[mid:b]))
    return left[: len(left) - gone_left] + encode(text[a:b]) + right[gone_right:]


def encode_tree(text: str, encode, leaf: int = LEAF_CHARS) -> list[int]:
    """ids of a text; encode maps a short text to its ids."""

    def part(lo: int, hi: int) -> list[int]:
        if hi - lo <= leaf:
            return encode(text[lo:hi])
        mid = (lo + hi) // 2
        return _join(text, lo, mid, hi, part(lo, mid), part(mid, hi), encode)

    return part(0, len(text))


def decode_tree(ids, path: str = VOCABULARY) -> str:
    """The text of ids; bytes concatenate up the tree."""
    return encoder(path).decode_bytes(list(ids)).decode("utf-8", "replace")


def encode_texts(texts: pd.Series, path: str, leaf: int) -> list[list[int]]:
    bpe = encoder(path)
    encode = bpe.encode_ordinary
    return [[] if not t else encode(t) if len(t) <= leaf else encode_tree(t, encode, leaf) for t in texts]


def token_ids(documents: DataFrame, *, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY, leaf: int = LEAF_CHARS) -> DataFrame:
    """The documents' other columns and ``ids``, the list of token ids; empty for an empty or null text.

    Each row is encoded where it stands, no shuffle. A column of the name ``ids`` is replaced.
    """

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(encode_texts(texts, vocabulary, leaf), dtype=object)

    return documents.withColumn(ids, F.pandas_udf(run, "array<int>")(documents[text].cast("string")))


def token_counts(documents: DataFrame, *, text: str = "text", count: str = "n_tokens", vocabulary: str = VOCABULARY, leaf: int = LEAF_CHARS) -> DataFrame:
    """The documents' other columns and ``count``, the number of tokens of the text; 0 for an empty or null text."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([len(x) for x in encode_texts(texts, vocabulary, leaf)], dtype="int64")

    return documents.withColumn(count, F.pandas_udf(run, "bigint")(documents[text].cast("string")))


def token_statistics(encoded: DataFrame, by: str = "lang") -> DataFrame:
    """Documents, tokens and longest text by a column."""
    return encoded.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
