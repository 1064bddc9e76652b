"""Top-k, ranked packing and version chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_symbols(scores: DataFrame, n: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "symbol").limit(n)


def greedy_fit(items: Column, budget: int) -> Column:
    """struct(used, kept, dropped, dropped_cost) of items (cost, name) in order: one that doesn't fit is left out, later ones may fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("kept"), F.lit(0).cast("long").alias("dropped"), F.lit(0).cast("long").alias("dropped_cost"))

    def step(acc, x):
        fits = acc.used + x.cost <= budget
        one = F.lit(1).cast("long")
        zero = F.lit(0).cast("long")
        return F.struct(
            (acc.used + F.when(fits, x.cost).otherwise(zero)).alias("used"), (acc.kept + F.when(fits, one).otherwise(zero)).alias("kept"),
            (acc.dropped + F.when(fits, zero).otherwise(one)).alias("dropped"), (acc.dropped_cost + F.when(fits, zero).otherwise(x.cost)).alias("dropped_cost"),
        )

    return F.aggregate(items, start, step)


def fit_by_group(df: DataFrame, by: str, order: str, cost: str, budget: int) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("cost")))), lambda x: F.struct(x.cost.alias("cost")))
    return df.groupBy(by).agg(items.alias("_i")).select(by, greedy_fit(F.col("_i"), budget).alias("_f")).select(by, "_f.*")


def budget_header(limit: int, f: str = "") -> Column:
    return F.format_string(f"§BUDGET limit={limit} used=%d dropped=%d dropped_tokens=%d", F.col(f + "used"), F.col(f + "dropped"), F.col(f + "dropped_cost"))


def latest(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The newest row of each key; the whole row rides in the aggregate, so there is no sort and no join."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(by, "_r.*")


def newest(df: DataFrame, order: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(order), tie).limit(n)


def next_sequence(new: DataFrame, old: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``new`` with seq going on from the largest of ``old`` for its key."""
    last = old.groupBy(by).agg(F.max("seq").alias("_m"))
    return new.join(last, by, "left").withColumn("seq", F.coalesce("_m", F.lit(0)) + F.row_number().over(Window.partitionBy(by).orderBy(*order))).drop("_m")


def broken_chain(df: DataFrame, by: str) -> DataFrame:
    """Rows (by, from_version, to_version) that don't go on from the one before, or don't rise."""
    prev = F.lag("to_version").over(Window.partitionBy(by).orderBy("from_version", "to_version"))
    return df.withColumn("_p", prev).filter((F.col("_p").isNotNull() & (F.col("_p") != F.col("from_version"))) | (F.col("to_version") <= F.col("from_version"))).drop("_p")


def occurrence(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def top_of_groups(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


