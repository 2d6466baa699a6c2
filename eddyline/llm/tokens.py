"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the published pattern that splits text before the merges of this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_RUN = 10_000
_SPACE_RUN = regex.compile(rf"\p{{White_Space}}{{{_LONG_RUN},}}")


@lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def length(coder: tiktoken.Encoding, text: str) -> int:
    """Tokens of the whole text. The pattern's matcher gives up on very long runs of white space; it makes one piece of such a run but for its last character, which goes with what
    follows, so the run is encoded as that piece and the text on either side by itself: the count is the same."""
    total, start = 0, 0
    for run in _SPACE_RUN.finditer(text) if len(text) >= _LONG_RUN else ():
        end = run.end() - (run.end() < len(text))
        total += len(coder.encode_ordinary(text[start : run.start()])) + len(coder._encode_single_piece(text[run.start() : end]))
        start = end
    return total + len(coder.encode_ordinary(text[start:]))


def token_count(text: str | Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """The number of tokens as long; null for a null text. The vocabulary is read once per Python worker from a path all workers see."""

    @F.pandas_udf("long")
    def count(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoder(path)
        for texts in series:
            yield pd.Series([None if t is None else length(coder, t) for t in texts], dtype="Int64")

    return count.asNondeterministic()(text)  # else a filter on the count is pushed below it and the text measured twice
