"""Inferred edges (edge_type, from_id, to_id, confidence, source) and annotations (symbol, key, value, confidence, source) beside asserted ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import is_identity

#: How sure a source is.
CONFIDENCE = {"structural": 1.0, "graph": 0.75, "heuristic": 0.5}


def at_least(rows: DataFrame, confidence: float) -> DataFrame:
    return rows.filter(F.col("confidence") >= confidence)


def annotations_for(annotations: DataFrame, symbol: str, confidence: float | None = None) -> DataFrame:
    out = annotations.filter(F.col("symbol") == symbol)
    return out if confidence is None else at_least(out, confidence)


def has_annotation(annotations: DataFrame, key: str) -> DataFrame:
    """One row: whether any symbol has the key."""
    return annotations.agg(F.coalesce(F.max(F.col("key") == key), F.lit(False)).alias("found"))


def families(inferred: DataFrame, edges: DataFrame, domain: str, entity_type: str, name: str) -> DataFrame:
    """family, relation, from_id, to_id of all edges that touch an entity: inferred ones by its name, asserted ones by its identity."""
    a = inferred.filter((F.col("from_id") == name) | (F.col("to_id") == name)).select(F.lit("inferred").alias("family"), F.col("edge_type").alias("relation"), "from_id", "to_id")
    touches = is_identity(domain, entity_type, name, cols=["s_domain", "s_type", "s_name"]) | is_identity(domain, entity_type, name, cols=["o_domain", "o_type", "o_name"])
    b = edges.filter(touches).select(F.lit("semantic").alias("family"), "relation", F.col("s_name").alias("from_id"), F.col("o_name").alias("to_id"))
    return a.unionByName(b)


def append_absent(left: DataFrame, derived: DataFrame, key: list[str]) -> DataFrame:
    """``left`` and those of ``derived`` whose key it lacks, each key of these once (the least row)."""
    rest = [c for c in left.columns if c not in key]
    new = derived.join(left.select(*key).distinct(), key, "left_anti")
    if rest:
        new = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    else:
        new = new.select(*key).distinct()
    return left.unionByName(new.select(*left.columns))


def enriched(calls: DataFrame, importance: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of calls (caller, callee), and annotations of importance (symbol, score) and dead code (symbol, reason)."""
    sure, source = F.lit(CONFIDENCE["graph"]).alias("confidence"), F.lit("graph").alias("source")
    edges = calls.select(F.lit("Calls").alias("edge_type"), F.col("caller").alias("from_id"), F.col("callee").alias("to_id"), sure, source)
    marks = importance.select("symbol", F.lit("importance").alias("key"), F.col("score").cast("string").alias("value"), sure, source)
    return edges, marks.unionByName(dead.select("symbol", F.lit("dead_code").alias("key"), F.col("reason").alias("value"), sure, source))


def fan_in(calls: DataFrame, inferred: DataFrame) -> DataFrame:
    """method, local, inferred, total and confidence: 0.85 where an inferred caller counts, else 1."""
    a = calls.select(F.col("to_id").alias("method"), F.lit(1).alias("l"), F.lit(0).alias("i"))
    b = inferred.filter("edge_type = 'Calls'").select(F.col("to_id").alias("method"), F.lit(0).alias("l"), F.lit(1).alias("i"))
    out = a.unionByName(b).groupBy("method").agg(F.sum("l").alias("local"), F.sum("i").alias("inferred"))
    return out.withColumn("total", F.col("local") + F.col("inferred")).withColumn("confidence", F.when(F.col("inferred") > 0, 0.85).otherwise(1.0))
