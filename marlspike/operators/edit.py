"""Aliases by first sight, structural edit batches, printed differences, and the overview of an architecture answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .graph import checkpointed

MOST_EDITS = 64


def aliases(sightings: DataFrame, path: str, order: str, prefix: str = "α", known: DataFrame | None = None) -> DataFrame:
    """alias, path of each distinct path, numbered by first sight (ties by path) after the largest number in ``known`` (alias, path).

    Rows of one path meet before they are numbered. Numbers without gaps need one order over all distinct paths: they are split by range of
    first sight, counted in each range, and only the counts (one row a range) are added up in one place.
    """
    first = sightings.filter(F.col(path).isNotNull()).groupBy(F.col(path).alias("path")).agg(F.min(order).alias("_at"))
    if known is not None:
        first = first.join(known.select("path"), "path", "left_anti")
    # a checkpoint, as the ranges are read twice and must be the same both times
    parts = checkpointed(first.repartitionByRange("_at", "path").withColumn("_part", F.spark_partition_id()))
    local = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("_at", "path")))
    sizes = local.groupBy("_part").agg(F.count("*").alias("_c"), F.min(F.struct("_at", "path")).alias("_least"))
    ahead = sizes.select("_part", (F.sum("_c").over(Window.orderBy("_least")) - F.col("_c")).alias("_before"))
    last = F.lit(0).cast("long")
    numbered = local.join(F.broadcast(ahead), "_part")
    if known is not None:
        top = known.agg(F.coalesce(F.max(F.regexp_extract("alias", r"^\D+(\d+)$", 1).try_cast("long")), F.lit(0).cast("long")).alias("_top"))
        numbered, last = numbered.crossJoin(F.broadcast(top)), F.col("_top")  # one row
    new = numbered.select(F.concat(F.lit(prefix), (F.col("_n") + F.col("_before") + last).cast("string")).alias("alias"), "path")
    return new if known is None else known.select("alias", "path").unionByName(new)


def edit_error(operations: Column, actual: str = "actual", expected: str = "expected") -> Column:
    """Why a batch is refused, or null. ``operations``: array of struct(start, stop, put, actual, expected) in request order.

    ``too_many`` beyond 64; ``mismatch`` where the text expected differs from the text there but for line ends (a null expectation isn't looked
    at); ``overlap`` where neighbours in request order meet: two ranges that share a place, or one point that lies strictly inside the range before.
    """
    wrong = F.exists(operations, lambda o: o[expected].isNotNull() & ~t.to_eol(o[actual], F.lit(False)).eqNullSafe(t.to_eol(o[expected], F.lit(False))))
    n = F.size(operations)
    pairs = F.arrays_zip(F.slice(operations, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(operations, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))

    def clash(p: Column) -> Column:
        a, b = p["a"], p["b"]
        wide_a, wide_b = a["start"] < a["stop"], b["start"] < b["stop"]
        both = wide_a & wide_b & (b["start"] < a["stop"]) & (a["start"] < b["stop"])
        return both | ((wide_a != wide_b) & (b["start"] > a["start"]) & (b["start"] < a["stop"]))

    return F.when(n > MOST_EDITS, "too_many").when(wrong, "mismatch").when(F.exists(pairs, clash), "overlap")


def printed(actions: DataFrame, order: str, low: Column, by: list[str]) -> DataFrame:
    """``by``, text: the actions of each group as lines, in ``order`` (ties by the line).

    Actions: target (class, method, field), kind (added, removed, modified, unchanged), label, detail, was, reason. Members are indented and a
    blank line comes before each class but the first, unless ``low``. One group is one array: a file's change set.
    """
    sign = F.element_at(F.create_map(*[F.lit(x) for kv in (("added", "+"), ("removed", "-"), ("modified", "~"), ("unchanged", "=")) for x in kv]), F.col("kind"))
    indent = F.when(low, "").otherwise("  ")
    is_class, line = F.col("target") == "class", lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in (*c, "\n")))
    label, detail, was = (F.coalesce(c, F.lit("")) for c in ("label", "detail", "was"))
    said = F.when(F.col("target") == "method", F.col("reason"))
    member = (
        F.when((F.col("kind") == "modified") & said.isin("body", "markers"), line(indent, sign, " ", label, " (", said, " changed)"))
        .when(F.col("kind") == "modified", F.concat(line(indent, sign, " ", label, " ~ ", detail), F.when(was != "", line(indent, "    was: ", was)).otherwise("")))
        .when(F.col("kind") == "unchanged", line(indent, sign, " ", detail))
        .otherwise(line(indent, sign, " ", label, " ", detail))
    )
    head = F.when(F.col("kind") == "unchanged", line("= ", label, " (unchanged)")).otherwise(line(sign, " ", label, " ", detail))
    each = F.struct(F.col(order).alias("o"), F.when(is_class, head).otherwise(member).alias("x"), (is_class & ~low).alias("blank"))
    rows = F.array_sort(F.collect_list(each))
    text = F.aggregate(rows, F.lit(""), lambda acc, r: F.concat(acc, F.when(r["blank"] & (acc != ""), "\n").otherwise(""), r["x"]))
    return actions.groupBy(*by).agg(text.alias("text"))


def overview(answers: DataFrame, body: str) -> DataFrame:
    """``answers`` with modules, array of struct(name, file_count), and dependencies, array of struct(from, to, kind), of a JSON answer.

    Entries without a name, or without either end, go; a count that isn't there is 0; a body that isn't JSON gives empty arrays.
    """
    shape = "packages array<struct<name string, node_count bigint>>, boundaries array<struct<`from` string, `to` string>>"
    x = F.from_json(F.col(body), shape)
    none = lambda a: F.coalesce(a, F.array())
    modules = F.transform(F.filter(x["packages"], lambda m: m["name"].isNotNull()), lambda m: F.struct(m["name"].alias("name"), F.coalesce(m["node_count"], F.lit(0).cast("long")).alias("file_count")))
    ends = F.transform(F.filter(x["boundaries"], lambda d: d["from"].isNotNull() & d["to"].isNotNull()), lambda d: F.struct(d["from"].alias("from"), d["to"].alias("to"), F.lit("calls").alias("kind")))
    return answers.withColumn("modules", none(modules)).withColumn("dependencies", none(ends))
