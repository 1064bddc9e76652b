"""Conversation operators: aging, cache breakpoints, hint deduplication, rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens_by_bytes


def paths_in(text):
    """Words with a slash, without quotes and brackets around them."""
    each = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"^[\"'`(\[{<]+|[\"'`)\]}>,;:.]+$", ""))
    return F.filter(each, lambda w: w.rlike(r"[/\\]"))


def age(messages: DataFrame, max_age: int, floor: int) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) with aged, text (a stub where aged) and saved bytes.

    Of roles other than assistant and system, a message more than ``max_age`` turns from the end goes, unless it is among
    the last ``floor`` or a path in it is mentioned there. One window by conversation numbers and counts its turns.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    all_ = Window.partitionBy("conv_id")
    m = messages.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(all_))
    recent = F.col("_i") >= F.col("_n") - floor
    # Only the last messages' paths are gathered: at most ``floor`` texts' worth for a conversation.
    m = m.withColumn("_paths", F.flatten(F.collect_list(F.when(recent, paths_in(F.col("text")))).over(all_)))
    mentioned = F.arrays_overlap(F.coalesce(paths_in(F.col("text")), F.array().cast("array<string>")), F.col("_paths"))
    aged = ~recent & ~F.col("role").isin("assistant", "system") & (F.col("_n") - F.col("_i") > max_age) & ~F.coalesce(mentioned, F.lit(False))
    stub = F.concat(F.lit("[aged: "), tokens_by_bytes(F.col("text")).cast("string"), F.lit(" tokens]"))
    return m.withColumn("aged", F.coalesce(aged, F.lit(False))).withColumn("saved", F.when(F.col("aged"), F.octet_length("text") - F.octet_length(stub)).otherwise(0)).withColumn("text", F.when(F.col("aged"), stub).otherwise(F.col("text"))).drop("_i", "_n", "_paths")


def breakpoints(messages: DataFrame, system_bytes: int = 500) -> DataFrame:
    """conv_id, system_turn, first_turn, tail_turn: where a cache may end; a system message counts above ``system_bytes``."""
    return messages.groupBy("conv_id").agg(
        F.max(F.when((F.col("role") == "system") & (F.octet_length("text") > system_bytes), F.col("turn"))).alias("system_turn"),
        F.min(F.when(F.octet_length("text") > 0, F.col("turn"))).alias("first_turn"), F.max(F.when(F.octet_length("text") > 0, F.col("turn"))).alias("tail_turn"),
    )


def hint_hits(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Per key: emissions after the first are hits. A count says as much as numbering them would, and needs no sort."""
    return events.groupBy(*key).agg(F.lit(1).cast("long").alias("misses"), (F.count("*") - 1).alias("hits"))


def token_bucket(requests: DataFrame, by: str, ts: str, capacity: float, per_second: float, idle: float = 120.0) -> DataFrame:
    """by, allowed, limited: each request takes a token; tokens come back at a rate; a bucket idle for long is new again.

    Requests of a key stream through its task in order of time, with the bucket as the only state.
    """

    def work(batches):
        import pandas as pd

        key, tokens, last, ok, no = None, capacity, None, 0, 0
        for b in batches:
            out = []
            for k, t in zip(b[by], b["_s"], strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, ok, no))
                    key, tokens, last, ok, no = k, capacity, None, 0, 0
                if last is not None:
                    tokens = capacity if t - last > idle else min(capacity, tokens + (t - last) * per_second)
                last = t
                if tokens >= 1:
                    tokens, ok = tokens - 1, ok + 1
                else:
                    no += 1
            yield pd.DataFrame(out, columns=[by, "allowed", "limited"])
        if key is not None:
            yield pd.DataFrame([(key, ok, no)], columns=[by, "allowed", "limited"])

    kind = requests.schema[by].dataType.simpleString()
    rows = requests.select(by, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_s"))
    return rows.repartition(by).sortWithinPartitions(by, "_s").mapInPandas(work, f"{by} {kind}, allowed long, limited long")
