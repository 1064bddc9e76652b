"""entities, edges and the other relations bound to the star-schema tables; and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ENTITIES = [("geo", "Region", "r_name", "region"), ("geo", "Nation", "n_name", "nation"), ("sales", "Customer", "c_name", "customer"), ("supply", "Supplier", "s_name", "supplier"), ("catalog", "Part", "p_partkey", "part"), ("sales", "Order", "o_orderkey", "orders")]


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(domain, kind, col, file):
        return table(spark, sf_dir, file).select(F.lit(domain).alias("domain"), F.lit(kind).alias("entity_type"), F.col(col).cast("string").alias("name"), F.lit(file).alias("file"))

    return reduce(DataFrame.unionByName, [one(*x) for x in _ENTITIES])


def _edge(df, relation, s, o, file, argc=None, spread=None, distinct=False):
    own = [F.col(s[2]).alias("s_name"), F.col(o[2]).alias("o_name"), *(x.alias(c) for x, c in ((argc, "argc"), (spread, "spread")) if x is not None)]
    df = df.select(*own)
    if distinct:
        df = df.distinct()
    return df.select(
        F.lit(relation).alias("relation"), F.lit(s[0]).alias("s_domain"), F.lit(s[1]).alias("s_type"), F.col("s_name").cast("string").alias("s_name"),
        F.lit(o[0]).alias("o_domain"), F.lit(o[1]).alias("o_type"), F.col("o_name").cast("string").alias("o_name"), F.lit("star").alias("layer"), F.lit(file).alias("asserting_file"),
        (F.lit(None) if argc is None else F.col("argc")).cast("int").alias("argc"), (F.lit(None) if spread is None else F.col("spread")).cast("boolean").alias("spread"),
    )


def edges(spark: SparkSession, sf_dir: str, distinct: bool = False) -> DataFrame:
    """With ``distinct`` each row once.

    No two parts share relation, types and file, and names are keys or text, so each part is made distinct by itself, on its few
    own columns as they are stored: no constant goes through the shuffle, and no part waits for another's.
    """
    t = lambda n: table(spark, sf_dir, n)
    part = lambda *x: _edge(*x, distinct=distinct)
    region, nation, customer, supplier, orders, lineitem = (t(n) for n in ("region", "nation", "customer", "supplier", "orders", "lineitem"))
    return reduce(DataFrame.unionByName, [
        part(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "HasEntity", ("geo", "Region", "r_name"), ("geo", "Nation", "n_name"), "nation"),
        part(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "CallsService", ("geo", "Nation", "n_name"), ("sales", "Customer", "c_name"), "customer"),
        part(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "CallsService", ("geo", "Nation", "n_name"), ("supply", "Supplier", "s_name"), "supplier"),
        part(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), "Injects", ("sales", "Customer", "c_name"), ("sales", "Order", "o_orderkey"), "orders"),
        part(lineitem, "ImportsModule", ("sales", "Order", "l_orderkey"), ("catalog", "Part", "l_partkey"), "lineitem", F.col("l_linenumber"), F.col("l_returnflag") == "R"),
        part(lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")), "Injects", ("supply", "Supplier", "s_name"), ("catalog", "Part", "l_partkey"), "lineitem", F.col("l_linenumber"), F.col("l_returnflag") == "R"),
    ])


def compression_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, file, domain, strategy, raw_tokens, compressed_tokens."""
    k = F.get_json_object("props", "$.k").cast("long")
    raw = F.floor(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.col("event_type").alias("domain"),
        F.when(k % 3 == 0, "delta").otherwise("full").alias("strategy"), raw.alias("raw_tokens"), F.floor(raw * k / 80).cast("long").alias("compressed_tokens"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, line of documents: a carriage return before a newline and a final empty line go."""
    each = F.split("text", "\r?\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.when(F.element_at(each, -1) == "", F.slice(each, 1, F.size(each) - 1)).otherwise(each)).alias("pos", "line"))


ENTITIES_SQL = " UNION ALL ".join(f"SELECT '{d}' AS domain, '{k}' AS entity_type, CAST({c} AS VARCHAR) AS name, '{f}' AS file FROM {f}" for d, k, c, f in _ENTITIES)


def _edge_sql(source, relation, s, o, file, evidence="CAST(NULL AS INTEGER) AS argc, CAST(NULL AS BOOLEAN) AS spread"):
    return f"SELECT '{relation}' AS relation, '{s[0]}' AS s_domain, '{s[1]}' AS s_type, CAST({s[2]} AS VARCHAR) AS s_name, '{o[0]}' AS o_domain, '{o[1]}' AS o_type, CAST({o[2]} AS VARCHAR) AS o_name, 'star' AS layer, '{file}' AS asserting_file, {evidence} FROM {source}"


_CALL = "CAST(l_linenumber AS INTEGER) AS argc, l_returnflag = 'R' AS spread"
EDGES_SQL = " UNION ALL ".join([
    _edge_sql("nation JOIN region ON n_regionkey = r_regionkey", "HasEntity", ("geo", "Region", "r_name"), ("geo", "Nation", "n_name"), "nation"),
    _edge_sql("customer JOIN nation ON c_nationkey = n_nationkey", "CallsService", ("geo", "Nation", "n_name"), ("sales", "Customer", "c_name"), "customer"),
    _edge_sql("supplier JOIN nation ON s_nationkey = n_nationkey", "CallsService", ("geo", "Nation", "n_name"), ("supply", "Supplier", "s_name"), "supplier"),
    _edge_sql("orders JOIN customer ON o_custkey = c_custkey", "Injects", ("sales", "Customer", "c_name"), ("sales", "Order", "o_orderkey"), "orders"),
    _edge_sql("lineitem", "ImportsModule", ("sales", "Order", "l_orderkey"), ("catalog", "Part", "l_partkey"), "lineitem", _CALL),
    _edge_sql("lineitem JOIN supplier ON l_suppkey = s_suppkey", "Injects", ("supply", "Supplier", "s_name"), ("catalog", "Part", "l_partkey"), "lineitem", _CALL),
])
EVENTS_SQL = """SELECT event_id AS seq, 'u' || CAST(user_id AS VARCHAR) AS file, event_type AS domain, CASE WHEN k % 3 = 0 THEN 'delta' ELSE 'full' END AS strategy,
 raw AS raw_tokens, CAST(floor(CAST(raw * k AS DOUBLE) / 80) AS BIGINT) AS compressed_tokens
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value * 100) AS BIGINT) AS raw FROM events)"""
LINES_SQL = r"""SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, each[pos] AS line FROM (SELECT doc_id, each, unnest(range(1, len(each) + 1)) AS pos FROM
 (SELECT doc_id, CASE WHEN e[-1] = '' THEN e[:-2] ELSE e END AS each FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS e FROM documents)))"""
WITH = f"WITH entities AS ({ENTITIES_SQL}), edges AS ({EDGES_SQL}) "
