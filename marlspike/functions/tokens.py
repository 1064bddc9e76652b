"""Exact token counts by a byte-pair vocabulary file, and the names tokenizers go by."""

from __future__ import annotations

import base64

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Tokenizers and their other names.
NAMES = {
    "cl100k": ["cl100k", "cl100k_base", "gpt4", "gpt-4", "gpt35", "gpt-3.5"], "o200k": ["o200k", "o200k_base", "gpt4o", "gpt-4o"],
    "claude": ["claude", "anthropic", "claude3", "claude-3"], "llama3": ["llama3", "llama-3", "llama", "meta"],
}
DEFAULT = "o200k"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def canonical(name: Column) -> Column:
    """The tokenizer that a name stands for, in any case; null for other names."""
    return F.element_at(F.create_map(*[F.lit(x) for k, own in NAMES.items() for n in own for x in (n, k)]), F.lower(name))


def resolved(*names: Column) -> Column:
    """The first of ``names`` (argument, environment, configuration) that is one, else the default."""
    return F.coalesce(*(canonical(n) for n in names), F.lit(DEFAULT))


def counter(spark: SparkSession, ranks_path: str, pattern: str = PATTERN):
    """A column function: how many tokens of the vocabulary file a text has; 0 for null. The file travels with the tasks."""
    import pandas as pd

    with open(ranks_path, "rb") as f:
        blob = spark.sparkContext.broadcast(f.read())
    held: dict[str, object] = {}

    def count(texts: pd.Series) -> pd.Series:
        import tiktoken

        if "bpe" not in held:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.value.splitlines())}
            held["bpe"] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return pd.Series([len(held["bpe"].encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    count.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(count, "long")
