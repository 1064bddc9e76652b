"""Operators over the instruction relation ir(file_id, version, pos, opcode, args)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Error codes of dangling references by opcode, and which argument refers.
REFERENCES = {"RET": "E001", "SIG": "E002", "FLAGS": "E003", "EXT": "E004", "IMPL": "E005", "INJECTS": "E006", "DATAFLOW": "E007", "CTRL": "E008", "EFFECT": "E009", "CTX": "E010", "CALL": "E011"}
DEFINITIONS = {"DEF_C": "Class", "DEF_I": "Interface", "DEF_M": "Method", "DEF_F": "Field"}
GRAPH_EDGES = {"EXT": "Extends", "EXT_I": "Extends", "IMPL": "Implements", "CALL": "Calls"}


def nodes(ir: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in DEFINITIONS.items() for x in kv])
    return ir.filter(F.col("opcode").isin(list(DEFINITIONS))).select("file_id", F.col("args")[0].alias("id"), F.col("args")[1].alias("name"), F.element_at(kind, F.col("opcode")).alias("kind"))


def graph_edges(ir: DataFrame) -> DataFrame:
    """file_id, edge_type, from_id, to_id; an INJECTS row gives one for each of its targets."""
    kind = F.create_map(*[F.lit(x) for kv in GRAPH_EDGES.items() for x in kv])
    plain = ir.filter(F.col("opcode").isin(list(GRAPH_EDGES))).select("file_id", F.element_at(kind, F.col("opcode")).alias("edge_type"), F.col("args")[0].alias("from_id"), F.col("args")[1].alias("to_id"))
    inject = ir.filter("opcode = 'INJECTS'").select("file_id", F.lit("Injects").alias("edge_type"), F.col("args")[0].alias("from_id"), F.explode(F.slice("args", 2, 1_000_000)).alias("to_id"))
    flow = ir.filter("opcode = 'DATAFLOW'").select("file_id", F.when(F.col("args")[1] == "reads", "Reads").otherwise("Writes").alias("edge_type"), F.col("args")[0].alias("from_id"), F.col("args")[2].alias("to_id"))
    return plain.unionByName(inject).unionByName(flow)


def dangling(ir: DataFrame) -> DataFrame:
    """file_id, pos, opcode, code of rows whose first argument names nothing defined in their file."""
    code = F.create_map(*[F.lit(x) for kv in REFERENCES.items() for x in kv])
    refs = ir.filter(F.col("opcode").isin(list(REFERENCES))).select("file_id", "pos", "opcode", F.col("args")[0].alias("id"))
    return refs.join(nodes(ir).select("file_id", "id"), ["file_id", "id"], "left_anti").select("file_id", "pos", "opcode", F.element_at(code, F.col("opcode")).alias("code"))


def first_error(ir: DataFrame) -> DataFrame:
    return dangling(ir).groupBy("file_id").agg(F.min_by(F.struct("pos", "opcode", "code"), "pos").alias("e")).select("file_id", "e.*")


def duplicates(ir: DataFrame) -> DataFrame:
    return nodes(ir).groupBy("file_id", "id").agg(F.count("*").alias("n")).filter("n > 1")


def string_table(ir: DataFrame) -> DataFrame:
    """file_id, value, code: distinct argument strings numbered by first use in their file."""
    each = ir.select("file_id", "pos", F.posexplode("args").alias("k", "value")).groupBy("file_id", "value").agg(F.min(F.struct("pos", "k")).alias("at"))
    return each.select("file_id", "value", (F.row_number().over(Window.partitionBy("file_id").orderBy("at")) - 1).alias("code"))


def nested(parents: DataFrame, children: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """``parents`` with an ordered array of their ``children``."""
    rest = [c for c in children.columns if c not in (key, order)]
    c = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))
    return parents.join(c, key, "left").withColumn(name, F.coalesce(name, F.array().cast(c.schema[name].dataType)))


def flat(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(key, F.explode(name).alias("_e")).select(key, "_e.*")
