"""Token-savings, filter and histogram aggregates. All are one hash aggregation, combined within tasks first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Histogram presets.
LATENCY_LINEAR = [float(10 * k) for k in range(1, 11)]
LATENCY_EXPONENTIAL = [float(2**k) for k in range(15)]
SIZE_BOUNDS = [1e2, 1e3, 1e4, 1e5, 1e6, 1e7, 1e8]


def saturating(raw: Column, compressed: Column) -> Column:
    return F.greatest(raw - compressed, F.lit(0))


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0))


def tenth(x: Column) -> Column:
    """Rounded half up to one place."""
    return F.floor(x * 10 + 0.5) / 10


def per_file(events: DataFrame) -> DataFrame:
    """The latest event of each file: it replaces earlier ones; version counts events and delta_count those of strategy delta.

    After a full event a delta keeps the token counts it found.
    """
    full = F.col("strategy") == "full"
    last = lambda c: F.max_by(c, "seq")
    return events.groupBy("file").agg(
        last("domain").alias("domain"), last("strategy").alias("strategy"), F.count("*").alias("version"), F.count_if(~full).alias("delta_count"),
        F.coalesce(F.max_by("raw_tokens", F.when(full, F.col("seq"))), F.max_by("raw_tokens", "seq")).alias("raw_tokens"),
        F.coalesce(F.max_by("compressed_tokens", F.when(full, F.col("seq"))), F.max_by("compressed_tokens", "seq")).alias("compressed_tokens"),
    )


def per_domain(files: DataFrame) -> DataFrame:
    """Sums, file count and the saturating savings percentage rounded to a tenth."""
    s = files.groupBy("domain").agg(F.sum("raw_tokens").alias("raw_tokens"), F.sum("compressed_tokens").alias("compressed_tokens"), F.count("*").alias("files"))
    return s.withColumn("savings_pct", tenth(pct(saturating(F.col("raw_tokens"), F.col("compressed_tokens")), F.col("raw_tokens"))))


def summary(files: DataFrame) -> DataFrame:
    """One row: totals, signed savings, the mean of the files' savings, and the share of deltas over delta files."""
    own = pct(saturating(F.col("raw_tokens"), F.col("compressed_tokens")), F.col("raw_tokens"))
    return files.agg(
        F.count("*").alias("files"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("compressed_tokens").alias("compressed_tokens"), (F.sum("raw_tokens") - F.sum("compressed_tokens")).alias("saved"),
        F.round(F.avg(own), 4).alias("mean_savings_pct"), F.round(F.avg(F.when(F.col("delta_count") > 0, F.col("delta_count") * 100.0 / F.col("version"))), 4).alias("mean_delta_share"),
    )


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sides' files: the larger version, summed deltas and the left tokens; a file of the right side alone as it is."""
    j = left.alias("l").join(right.alias("r"), "file", "full_outer")
    return j.select(
        "file", F.greatest(F.coalesce("l.version", F.lit(0)), F.coalesce("r.version", F.lit(0))).alias("version"),
        (F.coalesce("l.delta_count", F.lit(0)) + F.coalesce("r.delta_count", F.lit(0))).alias("delta_count"),
        *(F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in ("domain", "raw_tokens", "compressed_tokens")),
    )


def filter_stats(applied: DataFrame) -> DataFrame:
    """Per program: applications, tokens before, after and saved, and its share of all saved."""
    saved = saturating(F.col("raw_tokens"), F.col("compressed_tokens"))
    s = applied.groupBy("program").agg(F.count("*").alias("applications"), F.sum("raw_tokens").alias("tokens_before"), F.sum("compressed_tokens").alias("tokens_after"), F.sum(saved).alias("saved"))
    total = s.agg(F.sum("saved").alias("_t"))
    return s.crossJoin(F.broadcast(total)).select("program", "applications", "tokens_before", "tokens_after", "saved", F.round(pct(F.col("saved"), F.col("tokens_before")), 4).alias("saved_pct"), F.round(pct(F.col("saved"), F.col("_t")), 4).alias("share_pct"))


def histogram(df: DataFrame, value: str, bounds: list[float], by: list[str] | None = None) -> DataFrame:
    """bucket (0-based), n, total: the first bucket whose bound is at least the value; what exceeds all counts in the last."""
    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 1, -1, -1):
        bucket = F.when(F.col(value) <= bounds[i], i).otherwise(bucket)
    return df.filter(F.col(value).isNotNull()).groupBy(*(by or []), bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))


def recommend_fidelity(scores: DataFrame, by: str, fallback: str = "Medium") -> DataFrame:
    """The largest score of a file's symbols: above 0.8 High, below 0.4 Low, else the fallback."""
    return scores.groupBy(by).agg(F.max("score").alias("score")).withColumn("fidelity", F.when(F.col("score") > 0.8, "High").when(F.col("score") < 0.4, "Low").otherwise(fallback))


def blast_radius(reached: DataFrame, others: DataFrame) -> DataFrame:
    """file, impact of reached (file, symbol): 0.5 for its depth of one and 0.5 for up to ten symbols; other files 0.3."""
    hit = reached.groupBy("file").agg((F.lit(0.5) + F.lit(0.5) * F.least(F.count_distinct("symbol"), F.lit(10)) / 10).alias("impact"))
    return hit.unionByName(others.select("file").distinct().join(hit, "file", "left_anti").withColumn("impact", F.lit(0.3)))


def second_sightings(tokens: DataFrame) -> DataFrame:
    """token, opcode of (pos, token): a token seen again gets the next $n, in the order of second sightings.

    Numbers are dense over the whole table, so this ends in one ordered task; what reaches it is one row for each repeated
    token.
    """
    from pyspark.sql import Window

    two = tokens.withColumn("_k", F.row_number().over(Window.partitionBy("token").orderBy("pos"))).filter(F.col("_k") == 2)
    return two.select("token", F.concat(F.lit("$"), F.row_number().over(Window.orderBy("pos")).cast("string")).alias("opcode"))


def fingerprint(hashes: DataFrame) -> DataFrame:
    """Name of a workspace: the hash of its sorted file hashes."""
    return hashes.agg(F.concat(F.lit("ws_"), F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ","), 256)).alias("fingerprint"))


def cache_hits(hits: DataFrame) -> DataFrame:
    """One row of domain prompt_cache: tokens saved count as raw, none as compressed, so the saving is whole once there is a hit."""
    return hits.agg(
        F.lit("prompt_cache").alias("domain"), F.count("*").alias("cache_hits"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("raw_tokens"), F.lit(0).cast("long").alias("compressed_tokens"),
        F.when(F.count("*") > 0, 100.0).otherwise(0.0).alias("savings_pct"),
    )


def tool_filters(applied: DataFrame) -> DataFrame:
    """Per program (seq, program, raw_tokens, compressed_tokens) what ``per_file`` says of a file of its own, in domain tool_filter."""
    return per_file(applied.select("seq", F.concat(F.lit("__proxy__"), "program").alias("file"), F.lit("tool_filter").alias("domain"), F.lit("full").alias("strategy"), "raw_tokens", "compressed_tokens"))


def rebuilt(contexts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Compression events of stored contexts (id, file, fidelity number, tokens): a delta where the context has any (context_id), else full."""
    names = F.array(*map(F.lit, ("low", "medium", "high", "edit", "verbatim")))
    with_delta = deltas.select(F.col("context_id").alias("id")).distinct().withColumn("_d", F.lit(True))
    known = F.col("fidelity").between(0, 4)
    return contexts.join(with_delta, "id", "left").select(
        "file", F.when(F.col("_d"), "delta").otherwise("full").alias("strategy"), F.when(known, F.element_at(names, F.when(known, F.col("fidelity") + 1).otherwise(1).cast("int"))).otherwise("low").alias("fidelity"),
        *(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long").alias(c) for c in ("raw_tokens", "compressed_tokens")), F.lit("ir_compression").alias("domain"),
    )


def compression(ops: DataFrame, by: str) -> DataFrame:
    """source_ops, output_ops and their ratio, 0 without output, of (by, is_output)."""
    c = ops.groupBy(by).agg(F.count("*").alias("source_ops"), F.count_if("is_output").alias("output_ops"))
    return c.withColumn("ratio", F.when(F.col("output_ops") > 0, F.col("source_ops") / F.col("output_ops")).otherwise(F.lit(0.0)))


def commit_rollup(changes: DataFrame) -> DataFrame:
    """One row: changed files (status A, D, M, R, T; skipped) in all and by status."""
    n = lambda code, name: F.count_if(F.col("status") == code).alias(name)
    return changes.agg(F.count("*").alias("file_count"), n("A", "added"), n("D", "deleted"), n("M", "modified"), n("R", "renamed"), n("T", "type_changed"), F.count_if("skipped").alias("skipped"))
