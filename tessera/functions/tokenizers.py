"""Counts of sub-word tokens with a public tokenizer's file; the file's path is the caller's."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def subword_count(text: Column, ranks_file: str, pattern: str) -> Column:
    """How many tokens a byte-pair encoding makes of a text (null: null). ranks_file, which every executor can read, has a base64
    piece and its rank a line; pattern splits texts into words first."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for s in batches:
            yield s.map(lambda t: None if t is None else len(encoding.encode_ordinary(t))).astype("Int64")

    return count(text)
