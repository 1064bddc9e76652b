"""Queries over programs, inferred edges, coverage, requests and their statistics; see ``queries`` for how they are registered."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filters, tokens
from ..functions import text as t
from ..operators import coverage, graph, inference, program, requests, stats
from ..schema import DEPENDENCY_RELATIONS
from ..sources import derived
from ..sources.derived import ENTITIES_SQL, EVENTS_SQL, WITH, table
from .registry import query

E, G, EV = derived.entities, derived.edges, derived.compression_events

# --- programs: suppliers are classes, parts methods, lines of orders calls

_NODES = "SELECT 'n' || s_nationkey AS file_id, 's' || s_suppkey AS id, s_name AS name, 'Class' AS kind FROM supplier UNION ALL SELECT p_brand, 'p' || p_partkey, p_name, 'Method' FROM part"
_TYPED = "SELECT CASE l_returnflag WHEN 'R' THEN 'Calls' WHEN 'A' THEN 'Reads' ELSE 'Extends' END AS edge_type, 's' || l_suppkey AS from_id, 'p' || l_partkey AS to_id, l_shipmode AS file_id FROM lineitem".replace("l_shipmode", "'o' || (l_orderkey % 97)")
_INFERRED = "SELECT CASE l_returnflag WHEN 'R' THEN 'Calls' WHEN 'A' THEN 'DataFlowRead' ELSE 'Extends' END AS edge_type, 's' || l_suppkey AS from_id, 'p' || l_partkey AS to_id, CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE WHEN l_linenumber % 2 = 0 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM lineitem"
_MARKS = "SELECT p_brand AS file_id, 'p' || p_partkey AS id, 'ASYNC' AS mark FROM part WHERE p_size > 25"


def _id(prefix, c):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def nodes(s, d):
    a = table(s, d, "supplier").select(_id("n", "s_nationkey").alias("file_id"), _id("s", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("Class").alias("kind"))
    return a.unionByName(table(s, d, "part").select(F.col("p_brand").alias("file_id"), _id("p", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("Method").alias("kind")))


def _flag(r, a, other):
    return F.when(F.col("l_returnflag") == "R", r).when(F.col("l_returnflag") == "A", a).otherwise(other).alias("edge_type")


def typed(s, d):
    return table(s, d, "lineitem").select(_flag("Calls", "Reads", "Extends"), _id("s", "l_suppkey").alias("from_id"), _id("p", "l_partkey").alias("to_id"), F.concat(F.lit("o"), (F.col("l_orderkey") % 97).cast("string")).alias("file_id"))


def inferred(s, d):
    sure = F.when(F.col("l_linestatus") == "O", 1.0).when(F.col("l_linenumber") % 2 == 0, 0.75).otherwise(0.5)
    return table(s, d, "lineitem").select(_flag("Calls", "DataFlowRead", "Extends"), _id("s", "l_suppkey").alias("from_id"), _id("p", "l_partkey").alias("to_id"), sure.alias("confidence"))


def marks(s, d):
    return table(s, d, "part").filter("p_size > 25").select(F.col("p_brand").alias("file_id"), _id("p", "p_partkey").alias("id"), F.lit("ASYNC").alias("mark"))


query("b8_nodes_of_kind", f"SELECT * FROM ({_NODES}) WHERE kind = 'Method'")(lambda s, d: program.of_kind(nodes(s, d), "Method"))
query("b9_node_by_id", f"SELECT * FROM ({_NODES}) WHERE id = 's3'")(lambda s, d: program.by_id(nodes(s, d), "s3"))
query("b10_edges_of_type", f"SELECT * FROM ({_TYPED}) WHERE edge_type = 'Reads'")(lambda s, d: program.of_type(typed(s, d), "Reads"))
query("b11_confident_edges", f"SELECT * FROM ({_INFERRED}) WHERE confidence >= 0.75")(lambda s, d: inference.at_least(inferred(s, d), 0.75))

_NOTES = "SELECT 'c' || (event_id % 40) AS symbol, event_type AS key, CAST(value AS VARCHAR) AS value, CASE WHEN event_id % 3 = 0 THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END AS confidence, event_id FROM events"


def notes(s, d):
    return table(s, d, "events").select(F.concat(F.lit("c"), (F.col("event_id") % 40).cast("string")).alias("symbol"), F.col("event_type").alias("key"), F.when(F.col("event_id") % 3 == 0, 0.5).otherwise(0.75).alias("confidence"), "event_id")


query("b12_annotations", f"SELECT symbol, key, confidence, event_id FROM ({_NOTES}) WHERE symbol = 'c7' AND confidence >= 0.6")(lambda s, d: inference.annotations_for(notes(s, d), "c7", 0.6))
query("b12_all_annotations", f"SELECT symbol, key, confidence, event_id FROM ({_NOTES}) WHERE symbol = 'c7'")(lambda s, d: inference.annotations_for(notes(s, d), "c7"))
query("b13_has_annotation", "SELECT EXISTS (SELECT 1 FROM events WHERE event_type = 'purchase') AS found")(lambda s, d: inference.has_annotation(notes(s, d), "purchase"))
query("b15_edge_families", WITH + """SELECT 'inferred' AS family, edge_type AS relation, from_id, to_id FROM (SELECT CASE l_returnflag WHEN 'R' THEN 'Calls' WHEN 'A' THEN 'DataFlowRead' ELSE 'Extends' END AS edge_type, CAST(l_suppkey AS VARCHAR) AS from_id, CAST(l_partkey AS VARCHAR) AS to_id FROM lineitem) WHERE from_id = '7' OR to_id = '7'
 UNION ALL SELECT 'semantic', relation, s_name, o_name FROM edges WHERE (s_domain = 'catalog' AND s_type = 'Part' AND s_name = '7') OR (o_domain = 'catalog' AND o_type = 'Part' AND o_name = '7')""")(
    lambda s, d: inference.families(inferred(s, d).withColumns({c: F.substring(c, 2, 99) for c in ("from_id", "to_id")}), G(s, d), "catalog", "Part", "7"))
query("b16_async_methods", f"SELECT n.* FROM ({_NODES}) n WHERE kind = 'Method' AND EXISTS (SELECT 1 FROM ({_MARKS}) m WHERE m.file_id = n.file_id AND m.id = n.id)")(
    lambda s, d: program.methods_with(nodes(s, d), marks(s, d), "ASYNC").select("file_id", "id", "name", "kind"))
query("d1_fan_in_with_inferred", f"""SELECT method, CAST(sum(l) AS BIGINT) AS local, CAST(sum(i) AS BIGINT) AS inferred, CAST(sum(l) + sum(i) AS BIGINT) AS total, CASE WHEN sum(i) > 0 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS confidence
 FROM (SELECT to_id AS method, 1 AS l, 0 AS i FROM ({_TYPED}) WHERE edge_type = 'Calls' UNION ALL SELECT to_id, 0, 1 FROM ({_INFERRED}) WHERE edge_type = 'Calls' AND confidence < 0.7) GROUP BY 1""")(
    lambda s, d: inference.fan_in(program.of_type(typed(s, d), "Calls"), inferred(s, d).filter("confidence < 0.7")))

_REG = "SELECT event_id AS seq, 'm' || (event_id % 211) AS alias, event_type || (event_id % 53) AS original, 'Method' AS kind, 'u' || user_id AS file_id, event_id // 10 AS version FROM events"
_SYM = f"SELECT alias, arg_max(original, seq) AS original, arg_max(file_id, seq) AS file_id, max(seq) AS seq, arg_max(version, seq) AS version_last FROM ({_REG}) GROUP BY alias"


def registrations(s, d):
    e = table(s, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("m"), (F.col("event_id") % 211).cast("string")).alias("alias"), F.concat("event_type", (F.col("event_id") % 53).cast("string")).alias("original"),
                    F.lit("Method").alias("kind"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_id"), F.floor(F.col("event_id") / 10).cast("long").alias("version"))


query("l9_symbol_table", f"SELECT alias, original, 'Method' AS kind, file_id, version_last AS version_first, version_last, row_number() OVER (PARTITION BY original ORDER BY seq DESC) = 1 AS is_reverse FROM ({_SYM})")(
    lambda s, d: program.registered(registrations(s, d)))
query("b17_changed_since", f"SELECT alias, version_last FROM ({_SYM}) WHERE version_last > (90)")(lambda s, d: program.changed_since(program.registered(registrations(s, d)), 90).select("alias", "version_last"))
query("b17_changed_at_or_after", f"SELECT alias, version_last FROM ({_SYM}) WHERE version_last >= 90")(lambda s, d: program.changed_since(program.registered(registrations(s, d)), 90, True).select("alias", "version_last"))
query("b18_symbols_of_files", f"SELECT file_id, count(*) AS symbols FROM ({_SYM}) GROUP BY 1")(lambda s, d: program.counts_of_files(program.registered(registrations(s, d))))
query("b18_alias_of", f"SELECT original, alias FROM (SELECT *, row_number() OVER (PARTITION BY original ORDER BY seq DESC) AS k FROM ({_SYM})) WHERE k = 1 AND original = 'view5'")(
    lambda s, d: program.registered(registrations(s, d)).filter("is_reverse AND original = 'view5'").select("original", "alias"))

_LOW = "SELECT DISTINCT p_name AS name FROM part WHERE p_retailprice / 2200 < 0.4 AND (p_brand = 'src/Brand#1' OR ends_with('src/' || p_brand, '/' || 'Brand#11') OR ends_with('Brand#11', '/' || ('src/' || p_brand)))"
query("b20_skip_set", _LOW)(
    lambda s, d: program.skip_set(table(s, d, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("src/"), "p_brand").alias("file"), (F.col("p_retailprice") / 2200).alias("score")), "Brand#11"))
query("b19_unskipped", """SELECT 'p' || p_partkey AS id FROM part WHERE replace(p_name, ' ', '_') NOT IN (SELECT replace(p_name, ' ', '_') FROM part WHERE p_size < 10)""")(
    lambda s, d: (lambda p: program.unskipped(
        p.select(_id("p", "p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "class").when(F.col("p_partkey") % 3 == 1, "method").otherwise("field").alias("kind"),
                 F.when(F.col("p_partkey") % 3 == 0, F.col("n")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("public async "), "n", F.lit("<T>(a: T) { run(a) }"))).otherwise(F.concat(F.lit("private readonly "), "n", F.lit(": string = '';"))).alias("text")),
        p.filter("p_size < 10").select(F.col("n").alias("name"))).select("id"))(table(s, d, "part").withColumn("n", F.replace("p_name", F.lit(" "), F.lit("_")))))

_METHODS = "SELECT s_suppkey AS owner_id, 'p' || s_suppkey || '_' || k AS id, CASE WHEN k = 0 THEN 'run<T>' WHEN k = 1 THEN 'm' || s_suppkey ELSE 'shared' || (s_suppkey % 3) END AS name FROM supplier, (SELECT unnest([0, 1, 2]) AS k)"
query("b22_focus", f"""WITH m AS (SELECT owner_id, id, name FROM ({_METHODS}) UNION ALL SELECT owner_id, id, 'run' FROM ({_METHODS}) WHERE name = 'run<T>'), o AS (SELECT s_suppkey AS owner_id, 'C' || (s_suppkey % 7) || CASE WHEN s_suppkey > 7 THEN 'x' || s_suppkey ELSE '' END AS owner FROM supplier),
 s AS (SELECT DISTINCT 'C' || (s_suppkey % 7) || CASE WHEN s_suppkey > 7 THEN 'x' || s_suppkey ELSE '' END || '.' || CASE WHEN s_suppkey % 2 = 0 THEN 'run' ELSE 'none' END AS selector FROM supplier UNION SELECT 'm' || s_suppkey FROM supplier UNION SELECT * FROM (VALUES ('shared1'), ('nothing'), ('Nobody.run'), ('C1.run<T>'))),
 w AS (SELECT selector, CASE WHEN contains(selector, '.') THEN split_part(selector, '.', 1) END AS wanted, string_split(selector, '.')[-1] AS method FROM s),
 a AS (SELECT selector, wanted, method, (SELECT count(*) FROM o WHERE owner = wanted) AS owners, (SELECT list_sort(list_distinct(list(id))) FROM m JOIN o USING (owner_id) WHERE owner = wanted AND name = method) AS ids,
   (SELECT count(DISTINCT owner_id) FROM m WHERE name = method) AS holders, (SELECT list_sort(list_distinct(list(id))) FROM m WHERE name = method) AS bare FROM w)
 SELECT selector, CASE WHEN wanted IS NOT NULL THEN CASE WHEN owners = 0 THEN 'OwnerNotFound' WHEN owners > 1 THEN 'AmbiguousOwner' WHEN ids IS NULL THEN 'MethodNotFound' ELSE 'ok' END
  WHEN holders = 0 THEN 'MethodNotFound' WHEN holders > 1 THEN 'AmbiguousBareMethod' ELSE 'ok' END AS status,
  coalesce(array_to_string(CASE WHEN wanted IS NOT NULL AND owners = 1 THEN ids WHEN wanted IS NULL AND holders = 1 THEN bare END, ','), '') AS ids FROM a""")(
    lambda s, d: _focus(s, d))


def _focus(s, d):
    u = table(s, d, "supplier")
    k = F.col("s_suppkey").cast("string")
    owner = F.concat(F.lit("C"), (F.col("s_suppkey") % 7).cast("string"), F.when(F.col("s_suppkey") > 7, F.concat(F.lit("x"), k)).otherwise(""))
    m = u.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(F.col("s_suppkey").alias("owner_id"), F.concat(F.lit("p"), k, F.lit("_"), F.col("k").cast("string")).alias("id"),
        F.when(F.col("k") == 0, "run<T>").when(F.col("k") == 1, F.concat(F.lit("m"), k)).otherwise(F.concat(F.lit("shared"), (F.col("s_suppkey") % 3).cast("string"))).alias("name"))
    sel = u.select(F.concat(owner, F.lit("."), F.when(F.col("s_suppkey") % 2 == 0, "run").otherwise("none")).alias("selector")).union(u.select(F.concat(F.lit("m"), k)))
    sel = sel.union(s.createDataFrame([("shared1",), ("nothing",), ("Nobody.run",), ("C1.run<T>",)], "selector string"))
    return program.focused(m, u.select(F.col("s_suppkey").alias("owner_id"), owner.alias("owner")), sel).withColumn("ids", F.array_join("ids", ","))


_IR = "SELECT l_orderkey AS file_id, l_linenumber AS pos, CASE WHEN l_returnflag = 'R' THEN 'BODY' ELSE 'CALL' END AS opcode, 'p' || l_partkey AS id FROM lineitem"
query("b23_focused_bodies", f"SELECT * FROM ({_IR}) WHERE opcode <> 'BODY' OR id IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 40)")(
    lambda s, d: program.focused_bodies(
        table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_returnflag") == "R", "BODY").otherwise("CALL").alias("opcode"), F.array(_id("p", "l_partkey")).alias("args")),
        table(s, d, "part").filter("p_size > 40").select(_id("p", "p_partkey").alias("id"))).select("file_id", "pos", "opcode", F.col("args")[0].alias("id")))
query("c6_subclasses", f"SELECT * FROM ({_NODES}) WHERE id IN (SELECT from_id FROM ({_TYPED}) WHERE edge_type = 'Extends' AND to_id = 'p7')")(lambda s, d: program.subclasses(nodes(s, d), typed(s, d), "p7"))
query("i9_call_list", f"SELECT DISTINCT from_id AS caller, to_id AS callee FROM ({_TYPED}) WHERE edge_type = 'Calls'")(lambda s, d: program.call_list(typed(s, d)))
query("i13_calls_in_file", f"SELECT from_id AS caller, to_id AS callee, count(*) AS n FROM ({_TYPED}) WHERE edge_type = 'Calls' AND file_id = 'o5' GROUP BY ALL")(lambda s, d: program.calls_in(typed(s, d), "o5"))
query("c20_decode", "SELECT p_brand AS file_id, p_partkey AS pos, 'DEF' AS opcode, p_type || ',' || p_name AS args FROM part")(lambda s, d: _decode(s, d))


def _decode(s, d):
    p = table(s, d, "part").select(F.col("p_brand").alias("file_id"), F.col("p_partkey").alias("pos"), F.lit("DEF").alias("opcode"), F.array("p_type", "p_name").alias("args"))
    from ..operators import ir

    strings = ir.string_table(p)
    coded = p.select("file_id", "pos", "opcode", F.posexplode("args").alias("k", "value")).join(strings, ["file_id", "value"])
    coded = coded.groupBy("file_id", "pos", "opcode").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "code"))), lambda x: x.code).alias("args"))
    return program.decoded(coded, strings).withColumn("args", F.array_join("args", ","))


query("i14_edge_projection", "SELECT 'code' AS domain, 'Calls' AS relation, coalesce(o_orderpriority, 'o' || l_orderkey) AS subject, 'p' || l_partkey AS object, 'f' || (l_orderkey % 50) AS asserting_file FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 10 <> 0) ON l_orderkey = o_orderkey")(
    lambda s, d: _projection(s, d))


def _projection(s, d):
    from ..operators import ir

    file = lambda c: F.concat(F.lit("f"), (F.col(c) % 50).cast("string")).alias("file_id")
    rows = table(s, d, "orders").filter("o_orderkey % 10 <> 0").select(file("o_orderkey"), F.lit("DEF_M").alias("opcode"), F.array(_id("o", "o_orderkey"), "o_orderpriority").alias("args"))
    rows = rows.unionByName(table(s, d, "lineitem").select(file("l_orderkey"), F.lit("CALL").alias("opcode"), F.array(_id("o", "l_orderkey"), _id("p", "l_partkey")).alias("args")))
    return program.projected(rows, ir.nodes(rows), "code")


_WHO = "SELECT o_custkey AS file_id, o_orderkey AS key, o_orderkey % 6 AS r, o_orderpriority AS a, o_orderkey % 4 AS v FROM orders"
query("j3_intent", f"""SELECT file_id, intent, subject, detail FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY rank, key) AS k FROM (
 SELECT file_id, key, 0 AS rank, 'rename' AS intent, 'c' || key AS subject, a || ' -> ' || a || '!' AS detail FROM ({_WHO}) WHERE r = 0 AND v = 2
 UNION ALL SELECT file_id, key, 1, 'add_injection', 'c' || key, 'dep' || key FROM ({_WHO}) WHERE r = 1 AND v = 1
 UNION ALL SELECT file_id, key, 2, 'add_method', 'c' || key, a FROM ({_WHO}) WHERE r = 2 AND v = 2
 UNION ALL SELECT file_id, key, 3, 'remove_method', 'c' || key, a FROM ({_WHO}) WHERE r = 3 AND v = 3
 UNION ALL SELECT file_id, key, 4, 'change_return_type', 'm' || key, a || ' -> int' FROM ({_WHO}) WHERE r = 4 AND v = 0
 UNION ALL SELECT file_id, key, 5, 'change_signature', 'm' || key, CASE WHEN key % 8 = 1 THEN 'param_type' ELSE 'param_name' END FROM ({_WHO}) WHERE r = 5 AND v = 1)) WHERE k = 1""")(
    lambda s, d: _intent(s, d))


def _intent(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 6).alias("r"), F.col("o_orderpriority").alias("a"), (F.col("o_orderkey") % 4).alias("v"))
    c, m, dep, changed = _id("c", "key"), _id("m", "key"), _id("dep", "key"), F.col("v") == F.element_at(F.array(*map(F.lit, (2, 1, 2, 3, 0, 1))), (F.col("r") + 1).cast("int"))
    op = F.element_at(F.array(*map(F.lit, ("DEF_C", "INJECTS", "DEF_M", "DEF_M", "RET", "SIG"))), (F.col("r") + 1).cast("int"))
    old = F.when(F.col("r") == 0, F.array(c, "a")).when(F.col("r") == 1, F.array(c, F.lit("base"))).when(F.col("r") < 4, F.array(c, m, "a")).when(F.col("r") == 4, F.array(m, "a")).otherwise(F.array(m, F.lit("0"), F.lit("int"), F.lit("x")))
    by_type = F.col("key") % 8 == 1
    new = F.when(F.col("r") == 0, F.array(c, F.concat("a", F.lit("!")))).when(F.col("r") == 1, F.array(c, F.lit("base"), dep)).when(F.col("r") < 4, F.array(c, m, "a")).when(F.col("r") == 4, F.array(m, F.lit("int")))
    new = new.otherwise(F.array(m, F.lit("0"), F.when(by_type, "long").otherwise("int"), F.when(by_type, "x").otherwise("y")))
    x = o.withColumns({"opcode": op, "old": old, "new": F.when(changed, new).otherwise(old), "c": changed})
    before = x.filter("NOT (r = 2 AND c)").select("file_id", "key", "opcode", F.col("old").alias("args"))
    after = x.filter("NOT (r = 3 AND c)").select("file_id", "key", "opcode", F.col("new").alias("args"))
    return program.intent(before, after)


_CHG = "SELECT user_id AS file_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS from_version, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS to_version FROM events"
query("j6_version_gate", f"""SELECT file_id, seq FROM (SELECT *, max(CASE WHEN from_version <> to_version - 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY seq) AS bad FROM ({_CHG}) WHERE seq <= 800) WHERE bad = 0""")(lambda s, d: _gated(s, d))


def _gated(s, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(s, d, "events")
    changes = e.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seq"), (k - 1 + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)).alias("from_version"), k.alias("to_version"))
    return program.gated(changes, e.select(F.col("user_id").alias("file_id"), F.lit(0).alias("version")).distinct(), 800).select("file_id", "seq")


# --- inference and sets

query("f1_union_families", "SELECT family, count(*) AS n FROM (SELECT 'inferred' AS family FROM lineitem WHERE l_suppkey = 3 UNION ALL SELECT 'semantic' FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey = 3 UNION ALL SELECT 'semantic' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 3) GROUP BY 1")(
    lambda s, d: (lambda name: inference.families(inferred(s, d).withColumn("from_id", F.when(F.col("from_id") == "s3", name).otherwise(F.col("from_id"))), G(s, d), "supply", "Supplier", name).groupBy("family").agg(F.count("*").alias("n")))("Supplier#000000003"))
query("f2_append_absent", "SELECT l_orderkey AS o, l_partkey AS p, min(l_linenumber) AS n FROM (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag = 'R' AS own, max(l_returnflag = 'R') OVER (PARTITION BY l_orderkey, l_partkey) AS has FROM lineitem) WHERE NOT has GROUP BY ALL UNION ALL SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")(
    lambda s, d: (lambda x: inference.append_absent(x.filter("f = 'R'").drop("f"), x.filter("f <> 'R'").drop("f"), ["o", "p"]))(table(s, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("f"))))
query("f4_orphan_fields", "SELECT 'added' AS kind, n_name AS field FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT 'removed', n_name FROM nation WHERE n_nationkey < 5")(
    lambda s, d: (lambda n: graph.set_changes(n.filter("n_nationkey < 20").select("field"), n.filter("n_nationkey >= 5").select("field"), "field"))(table(s, d, "nation").withColumn("field", F.col("n_name"))))
query("f3_both_ways", "SELECT 'removed' AS kind, c_nationkey AS nation FROM (SELECT DISTINCT c_nationkey FROM customer) WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT 'added', s_nationkey FROM (SELECT DISTINCT s_nationkey FROM supplier) WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer)")(
    lambda s, d: graph.set_changes(table(s, d, "customer").select(F.col("c_nationkey").alias("nation")), table(s, d, "supplier").select(F.col("s_nationkey").alias("nation")), "nation"))
query("i11_enriched_edges", "SELECT DISTINCT 'Calls' AS edge_type, 's' || l_suppkey AS from_id, 'p' || l_partkey AS to_id, 0.75::DOUBLE AS confidence, 'graph' AS source FROM lineitem WHERE l_returnflag = 'R'")(lambda s, d: _enriched(s, d)[0])
query("i11_annotations", "SELECT 'p' || p_partkey AS symbol, 'importance' AS key, CAST(p_size AS VARCHAR) AS value, 0.75::DOUBLE AS confidence, 'graph' AS source FROM part UNION ALL SELECT 'p' || p_partkey, 'dead_code', 'no callers', 0.75, 'graph' FROM part WHERE p_size < 5")(lambda s, d: _enriched(s, d)[1])


def _enriched(s, d):
    p = table(s, d, "part").withColumn("symbol", _id("p", "p_partkey"))
    return inference.enriched(program.call_list(typed(s, d)), p.select("symbol", F.col("p_size").alias("score")), p.filter("p_size < 5").select("symbol", F.lit("no callers").alias("reason")))


# --- coverage and what is stored

query("b27_has_identity", f"SELECT EXISTS (SELECT 1 FROM ({ENTITIES_SQL}) WHERE domain = 'geo' AND entity_type = 'Nation' AND name = 'NATION_3' AND file = 'nation') AS covered")(lambda s, d: coverage.has_identity(E(s, d), "geo", "Nation", "NATION_3", ["nation"]))
query("b27_adjacency", WITH + "SELECT domain, entity_type, bool_or(f) AS forward, bool_or(NOT f) AS backward FROM (SELECT s_domain AS domain, s_type AS entity_type, true AS f FROM edges WHERE asserting_file = 'lineitem' UNION ALL SELECT o_domain, o_type, false FROM edges WHERE asserting_file = 'lineitem') GROUP BY ALL")(
    lambda s, d: coverage.adjacency(G(s, d), ["lineitem"]))
_FID = "['low', 'medium', 'high', 'edit', 'verbatim']"
query("b27_is_current", f"SELECT doc_id AS file, coalesce(doc_id % 3 <> 0 AND list_position({_FID}, {_FID}[1 + doc_id % 5]) >= list_position({_FID}, 'high') AND doc_id % 7 <> 0, false) AS current FROM documents")(lambda s, d: _current(s, d))


def _fid(c):
    return F.element_at(F.array(*map(F.lit, coverage.FIDELITIES)), (c % 5 + 1).cast("int"))


def _current(s, d):
    x = table(s, d, "documents").select(F.col("doc_id").alias("file"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    old = x.filter("file % 3 <> 0").select("file", F.when(F.col("file") % 7 == 0, "other").otherwise(F.col("hash")).alias("hash"), _fid(F.col("file")).alias("fidelity"))
    return coverage.is_current(x.withColumn("fidelity", F.lit("high")), old).select("file", "current")


query("f8_replace_projection", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 0, 0 FROM orders WHERE o_orderstatus = 'P'")(
    lambda s, d: coverage.replaced(table(s, d, "lineitem"), "l_orderkey", table(s, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).cast("long").alias("l_partkey"), F.lit(0).cast("long").alias("l_suppkey"))))
query("l5_discovery_complete", "SELECT scope, mode, name, fidelity, max(generation) AS generation, max(generation) = max(now) AS complete FROM (SELECT 'u' || user_id AS scope, event_type AS mode, 'n' || (event_id % 4) AS name, 'low' AS fidelity, event_id // 100 AS generation, max(event_id // 100) OVER (PARTITION BY user_id) AS now FROM events) GROUP BY ALL")(
    lambda s, d: (lambda x: coverage.complete(x, x.select("scope", "generation")))(table(s, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("scope"), F.col("event_type").alias("mode"), F.concat(F.lit("n"), (F.col("event_id") % 4).cast("string")).alias("name"), F.lit("low").alias("fidelity"), F.floor(F.col("event_id") / 100).cast("long").alias("generation"))))
query("l6_publishable", "SELECT doc_id AS file, doc_id % 5 <> 0 AND doc_id % 2 = 0 AS fresh FROM documents")(
    lambda s, d: (lambda x: coverage.publishable(x, x.filter("file % 5 <> 0").withColumn("hash", F.when(F.col("file") % 2 == 0, F.col("hash")).otherwise("x"))).select("file", "fresh"))(table(s, d, "documents").select(F.col("doc_id").alias("file"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))))
query("l7_compatibility", """SELECT o_orderkey, CASE WHEN k % 10 = 0 THEN 'source_mismatch' WHEN k % 5 < 2 THEN 'insufficient_fidelity' WHEN k % 7 = 0 THEN 'missing_legacy_identity' WHEN k % 7 = 1 THEN 'canonical_configuration_incompatible' WHEN k % 7 = 2 THEN 'semantic_configuration_incompatible'
 WHEN k % 7 = 3 THEN 'canonical_producer_incompatible' WHEN k % 7 = 4 THEN 'semantic_producer_incompatible' END AS reason FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""")(lambda s, d: _compatibility(s, d))


def _compatibility(s, d):
    k = F.col("o_orderkey")
    names = coverage.COMPONENTS
    now = F.struct(F.lit("h").alias("hash"), F.lit("high").alias("fidelity"), *(F.lit("v1").alias(n) for n in names))
    old = F.struct(F.when(k % 10 == 0, "x").otherwise("h").alias("hash"), _fid(k).alias("fidelity"), *(F.when((k % 7 == 0) & F.lit(n == names[2]), None).when(k % 7 == i + 1, "v0").otherwise("v1").alias(n) for i, n in enumerate(names)))
    return table(s, d, "orders").select("o_orderkey", old.alias("stored"), now.alias("current")).select("o_orderkey", coverage.failure().alias("reason"))


query("l8_unchanged", "SELECT user_id AS file, max(event_id) AS version, arg_max(event_type, event_id) = 'view' AS same FROM events GROUP BY 1")(
    lambda s, d: (lambda e: coverage.unchanged(e.select(F.col("user_id").alias("file"), F.lit("view").alias("hash")).distinct(), e.select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), F.col("event_type").alias("hash"), F.col("event_id").alias("version"))).select("file", "version", "same"))(table(s, d, "events")))

# --- statistics

query("d7_cache_hits", f"SELECT 'prompt_cache' AS domain, count(*) FILTER (strategy = 'delta') AS cache_hits, CAST(coalesce(sum(raw_tokens) FILTER (strategy = 'delta'), 0) AS BIGINT) AS raw_tokens, 0::BIGINT AS compressed_tokens, CASE WHEN count(*) FILTER (strategy = 'delta') > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS savings_pct FROM ({EVENTS_SQL})")(
    lambda s, d: stats.cache_hits(EV(s, d).filter("strategy = 'delta'").withColumnRenamed("raw_tokens", "tokens_saved")))
query("d8_tool_filters", f"SELECT '__proxy__' || domain AS file, 'tool_filter' AS domain, count(*) AS version, arg_max(raw_tokens, seq) AS raw_tokens, arg_max(compressed_tokens, seq) AS compressed_tokens FROM ({EVENTS_SQL}) GROUP BY domain")(
    lambda s, d: stats.tool_filters(EV(s, d).withColumnRenamed("domain", "program")).select("file", "domain", "version", "raw_tokens", "compressed_tokens"))
query("d12_rebuild", "SELECT 'o' || o_orderkey AS file, CASE WHEN n > 4 THEN 'delta' ELSE 'full' END AS strategy, ['low', 'medium', 'high', 'edit', 'verbatim', 'low', 'low'][1 + o_orderkey % 7] AS fidelity, greatest(o_custkey, 0) AS raw_tokens, 0::BIGINT AS compressed_tokens, 'ir_compression' AS domain FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")(
    lambda s, d: stats.rebuilt(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), _id("o", "o_orderkey").alias("file"), (F.col("o_orderkey") % 7).alias("fidelity"), F.col("o_custkey").alias("raw_tokens"), F.lit(-5).cast("long").alias("compressed_tokens")),
                               table(s, d, "lineitem").filter("l_linenumber > 4").select(F.col("l_orderkey").alias("context_id"))))
query("d19_compression", "SELECT l_orderkey AS file_id, count(*) AS source_ops, count(*) FILTER (l_returnflag = 'R') AS output_ops, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN round(count(*)::DOUBLE / count(*) FILTER (l_returnflag = 'R'), 6) ELSE 0.0 END AS ratio FROM lineitem GROUP BY 1")(
    lambda s, d: stats.compression(table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_returnflag") == "R").alias("is_output")), "file_id").withColumn("ratio", F.round("ratio", 6)))
query("d20_commit_rollup", "SELECT count(*) AS file_count, count(*) FILTER (event_type = 'signup') AS added, count(*) FILTER (event_type = 'error') AS deleted, count(*) FILTER (event_type = 'view') AS modified, count(*) FILTER (event_type = 'click') AS renamed, count(*) FILTER (event_type = 'purchase') AS type_changed, count(*) FILTER (value > 90) AS skipped FROM events")(
    lambda s, d: stats.commit_rollup(table(s, d, "events").select(F.element_at(F.create_map(*[F.lit(x) for kv in {"signup": "A", "error": "D", "view": "M", "click": "R", "purchase": "T"}.items() for x in kv]), F.col("event_type")).alias("status"), (F.col("value") > 90).alias("skipped"))))
query("d25_cache_merge", "SELECT user_id, " + ", ".join(f"CAST(sum(event_id % {i + 2}) AS BIGINT) AS {c}" for i, c in enumerate(requests.CACHE_COUNTERS)) + " FROM events GROUP BY 1")(
    lambda s, d: requests.merged(table(s, d, "events").select("user_id", *((F.col("event_id") % (i + 2)).alias(c) for i, c in enumerate(requests.CACHE_COUNTERS))), requests.CACHE_COUNTERS, ["user_id"]))
query("d26_transform_merge", "SELECT " + ", ".join(f"CAST(sum(event_id % {i + 2}) AS BIGINT) AS {c}" for i, c in enumerate(requests.TRANSFORM_COUNTERS)) + " FROM events")(
    lambda s, d: requests.merged(table(s, d, "events").select(*((F.col("event_id") % (i + 2)).alias(c) for i, c in enumerate(requests.TRANSFORM_COUNTERS))), requests.TRANSFORM_COUNTERS))

# --- requests

_SAID = "coalesce(text, '')"


def _requests(s, d):
    c = table(s, d, "conversations")
    secret = F.concat(F.coalesce("text", F.lit("")), F.lit(" token=abc"))
    part = F.struct(secret.alias("text"))
    block = lambda kind: F.struct(F.lit(kind).alias("type"), secret.alias("text"), secret.alias("content"), F.array(part).alias("parts"))
    tools = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(x).alias("description")) for n, x in (("Bash", "runs\n# Committing changes with git\nmore"), ("Read", "reads Committing changes"), ("Web", None))))
    return c.select("conv_id", "turn", F.lit("model-a").alias("model"), tools.alias("tools"), F.array(F.struct("role", F.array(block("text"), block("tool_result")).alias("content"))).alias("messages"))


query("f9_drop_tools", "SELECT conv_id, turn, 'Bash,Read' AS names FROM conversations")(lambda s, d: _requests(s, d).select("conv_id", "turn", F.array_join(F.transform(requests.drop_tools(F.col("tools"), ["Web", "None"]), lambda x: x["name"]), ",").alias("names")))
query("h20_trim_tool", "SELECT conv_id, turn, 'runs' || chr(10) || '# …' || chr(10) || chr(10) || '[Git commit/PR sections removed by proxy — set TRIM_BASH_GIT=0 to restore]' AS a, 'reads Committing changes' AS b, 'model-b' AS model FROM conversations")(
    lambda s, d: _requests(s, d).withColumn("tools", requests.trim_tool(F.col("tools"))).select("conv_id", "turn", F.col("tools")[0]["description"].alias("a"), F.col("tools")[1]["description"].alias("b"), requests.override_model(F.col("model"), "model-b").alias("model")))
_CLEAN = f"regexp_replace({_SAID} || ' token=abc', 'token=abc$', 'token=[REDACTED]')"
query("h17_scrub_messages", f"SELECT conv_id, turn, sha256({_CLEAN}) AS text, sha256({_SAID} || ' token=abc') AS content, sha256({_CLEAN}) AS result, sha256({_CLEAN}) AS part FROM conversations WHERE NOT regexp_matches({_SAID}, '(?i)(password|passwd|pwd|secret|token|key|authorization|://|eyJ|AKIA|ghp_|BEGIN|credential)')")(
    lambda s, d: table(s, d, "conversations").filter("NOT coalesce(text, '') rlike '(?i)(password|passwd|pwd|secret|token|key|authorization|://|eyJ|AKIA|ghp_|BEGIN|credential)'").select("conv_id", "turn").join(
        _requests(s, d).withColumn("c", requests.scrub_messages(F.col("messages"))[0]["content"]), ["conv_id", "turn"]).select("conv_id", "turn", *(F.sha2(x, 256).alias(n) for n, x in (("text", F.col("c")[0]["text"]), ("content", F.col("c")[0]["content"]), ("result", F.col("c")[1]["content"]), ("part", F.col("c")[1]["parts"][0]["text"])))).dropDuplicates(["conv_id", "turn"]))
query("h21_pipeline", f"SELECT conv_id, turn, 'model-b' AS model, 2 AS tools, sha256('<' || {_SAID} || ' token=abc>') AS text FROM conversations")(
    lambda s, d: requests.pipeline(drop=["Web"], trim=True, model="model-b", text_filter=lambda x: F.concat(F.lit("<"), x, F.lit(">")))(_requests(s, d)).select("conv_id", "turn", "model", F.size("tools").alias("tools"), F.sha2(F.col("messages")[0]["content"][0]["text"], 256).alias("text")))
query("h25_usage", "SELECT event_id, CAST(CASE event_id % 3 WHEN 2 THEN 0 ELSE event_id END AS BIGINT) AS read, CAST(CASE event_id % 3 WHEN 1 THEN 7 ELSE 0 END AS BIGINT) AS creation FROM events")(
    lambda s, d: table(s, d, "events").withColumn("b", F.when(F.col("event_id") % 3 == 0, F.format_string('{"usage": {"cache_read_input_tokens": %d}}', "event_id"))
        .when(F.col("event_id") % 3 == 1, F.format_string('event: x\ndata: {"type": "ping"}\r\ndata: {"type": "message_delta", "usage": {"cache_read_input_tokens": %d, "cache_creation_input_tokens": 7}}\ndata: [DONE]\n', "event_id")).otherwise("data: [DONE]"))
        .select("event_id", requests.usage(F.col("b")).alias("u")).select("event_id", "u.read", "u.creation"))
query("g15_json_guard", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props WHEN event_id % 3 = 0 THEN 'cut' ELSE 'cut' END AS text, event_id % 2 <> 0 AS truncated FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", requests.json_guard(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat("props", F.lit("x"))), F.lit("cut"), F.lit(True)).alias("g")).select("event_id", "g.text", "g.truncated"))
query("g16_marker", "SELECT event_id, '§FILTERED ' || event_type || ': ' || event_id || ' → 3 lines (' || CASE WHEN event_id % 2 = 0 THEN '12.5' ELSE '0.0' END || '% ↓)' AS marker FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", requests.marker(F.col("event_type"), F.col("event_id"), F.lit(3), F.when(F.col("event_id") % 2 == 0, 12.5).otherwise(0.0)).alias("marker")))

# --- graph

query("c14_ambiguous_identities", WITH + "SELECT 'geo' AS domain, 'Nation' AS entity_type, name, CAST(list(DISTINCT file ORDER BY file) AS VARCHAR) AS files FROM (SELECT n_name AS name, 'nation' AS file FROM nation UNION ALL SELECT n_name, 'again' FROM nation WHERE n_nationkey < 3) GROUP BY name HAVING count(DISTINCT file) > 1")(
    lambda s, d: (lambda e: graph.ambiguous(e.unionByName(table(s, d, "nation").filter("n_nationkey < 3").select(F.lit("geo").alias("domain"), F.lit("Nation").alias("entity_type"), F.col("n_name").alias("name"), F.lit("again").alias("file"))), e.filter("entity_type = 'Nation'").select("domain", "entity_type", "name")).withColumn("files", F.concat(F.lit("["), F.array_join("files", ", "), F.lit("]"))))(E(s, d)))
_DEPS = ", ".join(f"'{r}'" for r in DEPENDENCY_RELATIONS)
query("i6_trace_both", "SELECT DISTINCT s_name AS from_id, o_name AS to_id, relation AS label FROM (" + f"{WITH} SELECT * FROM edges" + ") WHERE o_name = 'AFRICA' OR s_name = 'AFRICA' OR s_name IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA') OR (s_name IN (SELECT c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA') AND relation = 'Injects') OR (relation = 'Injects' AND s_name IN (SELECT s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA'))")(
    lambda s, d: graph.trace(_plain(s, d), "AFRICA", ""))
query("i6_trace_to", "SELECT DISTINCT n_name AS from_id, c_name AS to_id, 'CallsService' AS label FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = 1) AND c_custkey = 1 UNION SELECT c_name, CAST(o_orderkey AS VARCHAR), 'Injects' FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey = 1")(
    lambda s, d: graph.trace(_plain(s, d), table(s, d, "customer").filter("c_custkey = 1").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).head()["r_name"], "Customer#000000001"))


def _plain(s, d):
    return G(s, d).select(F.col("s_name").alias("from_id"), F.col("o_name").alias("to_id"), F.col("relation").alias("label"))


# --- text

query("g41_line_ends", "SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS h, CASE WHEN strlen(text) <= 60 THEN text END AS short FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(t.to_eol(F.col("text"), F.lit(False)), 256).alias("h"), F.when(F.octet_length("text") <= 60, t.bounded(F.col("text"), 60)).alias("short")))
query("j10_class_summary", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 AND p_size % 4 > 0 THEN (p_size % 3) || ' fields, ' || (p_size % 4) || ' methods' WHEN p_size % 3 > 0 THEN (p_size % 3) || ' fields' WHEN p_size % 4 > 0 THEN (p_size % 4) || ' methods' ELSE '' END AS summary FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", t.class_summary(F.col("p_size") % 3, F.col("p_size") % 4).alias("summary")))
query("g43_rows_to_edges", "SELECT n_name AS from_id, r_name AS to_id, 'HasEntity' AS label, '{\"k\":\"' || n_nationkey || '\"}' AS properties FROM nation JOIN region ON n_regionkey = r_regionkey")(
    lambda s, d: graph.rows_to_edges(table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.lit("HasEntity").alias("type( r )"), F.col("n_nationkey").cast("string").alias("k"), "r_name")))

query("h26_platform", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'anthropic' WHEN p_size % 4 = 1 THEN 'openai' ELSE 'generic' END AS platform FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", requests.platform(F.element_at(F.array(F.lit("x-claude-y"), F.lit("gpt-x"), F.lit("mygpt-"), F.lit("")), (F.col("p_size") % 4 + 1).cast("int"))).alias("platform")))
_BLOCKS = "SELECT l_orderkey AS k, CASE l_linenumber % 4 WHEN 0 THEN 'tools' WHEN 1 THEN 'system' ELSE 'messages' END AS part, CAST(l_linenumber % 2 AS BIGINT) AS message, l_partkey AS pos, CASE WHEN l_returnflag = 'R' THEN 'thinking' ELSE 'text' END AS kind, CAST(l_quantity * 20 AS BIGINT) AS size, l_orderkey % 9 = 0 AS marked FROM lineitem"
query("h22_cache_slots", f"""SELECT k, preserved, CASE WHEN NOT preserved THEN tool END AS tool, CASE WHEN NOT preserved THEN sys END AS system, CASE WHEN NOT preserved THEN f END AS first, CASE WHEN NOT preserved THEN t // 100000000 END AS tail_message, CASE WHEN NOT preserved THEN t % 100000000 END AS tail_pos FROM (
 SELECT k, bool_or(marked) AS preserved, max(pos) FILTER (part = 'tools') AS tool, max(pos) FILTER (part = 'system' AND size > 500) AS sys, max(pos) FILTER (part = 'messages' AND kind = 'text' AND message = 0) AS f, max(message * 100000000 + pos) FILTER (part = 'messages' AND kind = 'text') AS t FROM ({_BLOCKS}) GROUP BY k)""")(
    lambda s, d: requests.cache_slots(table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_linenumber") % 4 == 0, "tools").when(F.col("l_linenumber") % 4 == 1, "system").otherwise("messages").alias("part"),
        (F.col("l_linenumber") % 2).cast("long").alias("message"), F.col("l_partkey").alias("pos"), F.when(F.col("l_returnflag") == "R", "thinking").otherwise("text").alias("kind"), (F.col("l_quantity") * 20).cast("long").alias("size"), (F.col("l_orderkey") % 9 == 0).alias("marked")), "k"))
query("g12_tokenizer_name", "SELECT event_id, CASE event_type WHEN 'view' THEN 'cl100k' WHEN 'click' THEN 'claude' WHEN 'error' THEN 'llama3' ELSE 'o200k' END AS name FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", tokens.resolved(F.when(F.col("event_type") == "view", "GPT-4"), F.when(F.col("event_type") == "error", "Meta").when(F.col("event_type") == "signup", "what"), F.when(F.col("event_type") == "click", "Claude-3")).alias("name")))
_RULES = filters.load("""
[filters.short]
match_command = "^cat\\\\b"
head_lines = 2
[filters.shorter]
match_command = "^cat x\\\\b"
head_lines = 1
""")
query("h4_filter_by_command", "SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN string_split_regex(text, '\\r?\\n')[1] WHEN 1 THEN text ELSE text END) AS h FROM documents WHERE len(string_split_regex(text, '\\r?\\n')) > 2 AND doc_id % 3 < 2")(
    lambda s, d: table(s, d, "documents").filter("size(split(text, '\\r?\\n')) > 2 AND doc_id % 3 < 2").select("doc_id", F.sha2(filters.apply_selected(_RULES, F.when(F.col("doc_id") % 3 == 0, "cat x y").otherwise("vi x"), F.col("text")), 256).alias("h")))
