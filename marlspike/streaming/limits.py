"""Streaming forms of the stateful operators: rate limits by key and replacing upserts by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_bucket(requests: DataFrame, by: str, ts: str, capacity: float, per_second: float, idle: float = 120.0) -> DataFrame:
    """by, seconds, allowed for each request of a stream, bucket state kept by key; an idle bucket is new again.

    Late rows count at the time of the latest row of their key.
    """

    def step(key, batches, state):
        import pandas as pd

        tokens, last = state.get if state.exists else (capacity, None)
        out = []
        for t in sorted(x for b in batches for x in b["_s"]):
            if last is not None:
                t = max(t, last)
                tokens = capacity if t - last > idle else min(capacity, tokens + (t - last) * per_second)
            last = t
            out.append((key[0], t, tokens >= 1))
            tokens -= tokens >= 1
        state.update((tokens, last))
        yield pd.DataFrame(out, columns=[by, "seconds", "allowed"])

    kind = requests.schema[by].dataType.simpleString()
    rows = requests.select(by, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_s"))
    return rows.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, seconds double, allowed boolean", "tokens double, last double", "append", "NoTimeout")
