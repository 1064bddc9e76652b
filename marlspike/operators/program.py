"""Selections and joins over a program: nodes (file_id, id, name, kind), typed edges, symbols and bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("kind") == kind)


def by_id(nodes: DataFrame, node: str) -> DataFrame:
    """The first node of an id, by file."""
    return nodes.filter(F.col("id") == node).orderBy("file_id", "name").limit(1)


def of_type(edges: DataFrame, edge_type: str) -> DataFrame:
    return edges.filter(F.col("edge_type") == edge_type)


def methods_with(nodes: DataFrame, marks: DataFrame, mark: str) -> DataFrame:
    """Methods that carry a mark (file_id, id, mark), such as ASYNC or a side effect."""
    return of_kind(nodes, "Method").join(marks.filter(F.col("mark") == mark).select("file_id", "id"), ["file_id", "id"], "left_semi")


def subclasses(nodes: DataFrame, edges: DataFrame, parent: str) -> DataFrame:
    """Nodes with an Extends edge onto ``parent``."""
    return nodes.join(of_type(edges, "Extends").filter(F.col("to_id") == parent).select(F.col("from_id").alias("id")), "id", "left_semi").select(*nodes.columns)


def changed_since(symbols: DataFrame, version: int, inclusive: bool = False) -> DataFrame:
    """Symbols (alias, original, file_id, version_last) whose last change is after ``version``, or at it too."""
    return symbols.filter(F.col("version_last") >= version if inclusive else F.col("version_last") > version)


def registered(events: DataFrame) -> DataFrame:
    """The symbol table that registrations (seq, alias, original, kind, file_id, version) leave.

    Of an alias's registrations the last holds with its version as first and last; of one original the last alias that
    names it is its reverse entry.
    """
    last = events.groupBy("alias").agg(F.max_by(F.struct("seq", "original", "kind", "file_id", "version"), "seq").alias("_r")).select("alias", "_r.*")
    back = F.row_number().over(Window.partitionBy("original").orderBy(F.desc("seq"))) == 1
    return last.select("alias", "original", "kind", "file_id", F.col("version").alias("version_first"), F.col("version").alias("version_last"), back.alias("is_reverse"))


def counts_of_files(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("file_id").agg(F.count("*").alias("symbols"))


def plain(name: Column) -> Column:
    """A method's name without a generic suffix."""
    return F.when(name.endswith(">") & (F.instr(name, "<") > 0), F.substring_index(name, "<", 1)).otherwise(name)


def focused(methods: DataFrame, owners: DataFrame, selectors: DataFrame) -> DataFrame:
    """selector, status, ids (sorted) of selectors ``Owner.method`` or ``method`` against methods (owner_id, id, name) and owners (owner_id, owner).

    A bare selector must name a method of one owner only; all overloads under the owner are selected.
    """
    cut = F.length("selector") - F.length(F.substring_index("selector", ".", -1)) - 1
    s = selectors.select("selector", F.when(cut >= 0, F.substring("selector", F.lit(1), cut)).alias("wanted"), F.substring_index("selector", ".", -1).alias("method")).distinct()
    named = s.filter("wanted is not null").join(owners.select(F.col("owner").alias("wanted"), "owner_id"), "wanted", "left")
    n = named.groupBy("selector").agg(F.count_distinct("owner_id").alias("owners"))
    names = methods.select("owner_id", "id", F.explode(F.array_distinct(F.array("name", plain(F.col("name"))))).alias("method"))
    ids = F.array_sort(F.collect_set("id")).alias("ids")
    hit = named.join(names, ["owner_id", "method"]).groupBy("selector").agg(ids)
    dotted = n.join(hit, "selector", "left").select(
        "selector", F.when(F.col("owners") == 0, "OwnerNotFound").when(F.col("owners") > 1, "AmbiguousOwner").when(F.col("ids").isNull(), "MethodNotFound").otherwise("ok").alias("status"), "ids"
    )
    bare = s.filter("wanted is null").join(names, "method", "left").groupBy("selector").agg(F.count_distinct("owner_id").alias("owners"), ids)
    bare = bare.select("selector", F.when(F.col("owners") == 0, "MethodNotFound").when(F.col("owners") > 1, "AmbiguousBareMethod").otherwise("ok").alias("status"), "ids")
    out = dotted.unionByName(bare)
    return out.withColumn("ids", F.when(F.col("status") == "ok", F.col("ids")).otherwise(F.array().cast("array<string>")))


def focused_bodies(ir: DataFrame, ids: DataFrame) -> DataFrame:
    """``ir`` without the bodies of methods that aren't in ``ids`` (id)."""
    bodies = ir.filter("opcode = 'BODY'")
    kept = bodies.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("args")[0] == F.col("_id"), "left_semi")
    return ir.filter("opcode <> 'BODY'").unionByName(kept)


def skip_set(scores: DataFrame, path: str, below: float = 0.4) -> DataFrame:
    """Names of symbols (name, file, score) under ``below`` whose file matches the path."""
    from ..functions.text import path_matches

    return scores.filter((F.col("score") < below) & path_matches(F.col("file"), F.lit(path))).select("name").distinct()


def capture_name(kind: Column, text: Column) -> Column:
    """The declared name that a capture's text holds: of a method what stands before the first bracket, without generics; of a field what stands before the colon."""
    last = lambda x: F.element_at(F.split(F.trim(x), r"\s+"), -1)
    before = F.substring_index(text, "(", 1)
    method = F.when(F.instr(text, "(") > 0, F.trim(F.substring_index(last(before), "<", 1))).otherwise(F.trim(text))
    return F.when(kind == "method", method).when(kind == "field", last(F.substring_index(text, ":", 1))).otherwise(F.trim(text))


def unskipped(captures: DataFrame, skipped: DataFrame) -> DataFrame:
    """Captures (kind, text, ...) but those of classes, methods and fields named in ``skipped`` (name)."""
    name = F.when(F.col("kind").isin("class", "method", "field"), capture_name(F.col("kind"), F.col("text")))
    return captures.withColumn("_n", name).join(skipped.select(F.col("name").alias("_n")).distinct(), "_n", "left_anti").drop("_n")


def decoded(ir: DataFrame, strings: DataFrame) -> DataFrame:
    """file_id, pos, opcode, args of rows whose args are codes of their file's string table (file_id, code, value)."""
    each = ir.select("file_id", "pos", "opcode", F.posexplode("args").alias("_k", "code")).join(strings, ["file_id", "code"])
    return each.groupBy("file_id", "pos", "opcode").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "value"))), lambda s: s.value).alias("args"))


def call_list(edges: DataFrame) -> DataFrame:
    return of_type(edges, "Calls").select(F.col("from_id").alias("caller"), F.col("to_id").alias("callee")).distinct()


def calls_in(edges: DataFrame, file_id: str) -> DataFrame:
    """caller, callee, n of the calls a file makes."""
    return of_type(edges, "Calls").filter(F.col("file_id") == file_id).groupBy(F.col("from_id").alias("caller"), F.col("to_id").alias("callee")).agg(F.count("*").alias("n"))


def projected(ir: DataFrame, nodes: DataFrame, domain: str) -> DataFrame:
    """Semantic edges of instructions: (relation, subject, object, asserting_file) with ids read as names where their file defines them."""
    from .ir import graph_edges

    e = graph_edges(ir)
    name = lambda c: nodes.select(F.col("file_id"), F.col("id").alias(c), F.col("name").alias(f"_{c}"))
    j = e.join(name("from_id"), ["file_id", "from_id"], "left").join(name("to_id"), ["file_id", "to_id"], "left")
    return j.select(F.lit(domain).alias("domain"), F.col("edge_type").alias("relation"), F.coalesce("_from_id", "from_id").alias("subject"), F.coalesce("_to_id", "to_id").alias("object"), F.col("file_id").alias("asserting_file"))


#: Intents in the order in which the first that applies is told, and the opcodes they look at.
INTENTS = ["rename", "add_injection", "add_method", "remove_method", "change_return_type", "change_signature"]


def intent(before: DataFrame, after: DataFrame) -> DataFrame:
    """file_id, intent, subject, detail: what most explains how a file's rows (file_id, key, opcode, args) changed, if anything does.

    Of several candidates the first by rule and then by key is told.
    """
    side = lambda d, c: d.groupBy("file_id", "key").agg(F.max(F.struct("opcode", "args")).alias(c))
    j = side(before, "x").join(side(after, "y"), ["file_id", "key"], "full_outer")
    both = F.col("x.opcode") == F.col("y.opcode")
    op, a, b = F.coalesce("y.opcode", "x.opcode"), F.col("x.args"), F.col("y.args")
    name = F.when(op == "DEF_C", 1).otherwise(2)
    at = lambda args, i: F.get(args, F.lit(i) if isinstance(i, int) else i)
    new = F.get(F.filter(F.slice(b, 2, 1 << 30), lambda d: ~F.array_contains(F.coalesce(F.slice(a, 2, 1 << 30), F.array().cast("array<string>")), d)), F.lit(0))
    arrow = lambda x, y: F.concat(x, F.lit(" -> "), y)
    rules = [
        (both & op.isin("DEF_C", "DEF_M", "DEF_F") & (at(a, name) != at(b, name)), at(a, 0), arrow(at(a, name), at(b, name))),
        ((op == "INJECTS") & F.col("y").isNotNull() & F.coalesce(new.isNotNull(), F.lit(False)), at(b, 0), new),
        ((op == "DEF_M") & F.col("x").isNull(), at(b, 0), at(b, 2)),
        ((op == "DEF_M") & F.col("y").isNull(), at(a, 0), at(a, 2)),
        (both & (op == "RET") & (at(a, 1) != at(b, 1)), at(a, 0), arrow(at(a, 1), at(b, 1))),
        (both & (op == "SIG") & ((at(a, 2) != at(b, 2)) | (at(a, 3) != at(b, 3))), at(a, 0), F.when(at(a, 2) != at(b, 2), "param_type").otherwise("param_name")),
    ]
    told = F.lit(None).cast("struct<rank:int,subject:string,detail:string>")
    for rank in range(len(rules) - 1, -1, -1):
        hit, subject, detail = rules[rank]
        told = F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(rank).alias("rank"), subject.alias("subject"), detail.alias("detail"))).otherwise(told)
    j = j.withColumn("_t", told).filter("_t is not null")
    first = j.groupBy("file_id").agg(F.min_by("_t", F.struct("_t.rank", "key")).alias("_t"))
    return first.select("file_id", F.element_at(F.array(*map(F.lit, INTENTS)), F.col("_t.rank") + 1).alias("intent"), "_t.subject", "_t.detail")


def gated(changes: DataFrame, current: DataFrame, target: int | None = None) -> DataFrame:
    """The changes (file_id, from_version, to_version, seq, ...) that apply in order on files (file_id, version).

    A file's changes count up to the first that doesn't go on from the version reached, and up to sequence ``target``.
    """
    if target is not None:
        changes = changes.filter(F.col("seq") <= target)
    w = Window.partitionBy("file_id").orderBy("seq")
    x = changes.join(current.select("file_id", F.col("version").alias("_v")), "file_id")
    x = x.withColumn("_p", F.coalesce(F.lag("to_version").over(w), F.col("_v")))
    bad = (F.col("_p") != F.col("from_version")) | (F.col("to_version") <= F.col("from_version"))
    return x.withColumn("_bad", F.max(bad.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_bad = 0").drop("_bad", "_p", "_v")
