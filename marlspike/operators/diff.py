"""Keyed, member and positional differences, their replay, and edit batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed(base: DataFrame, current: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, kind (added, deleted, modified), before, after. Of a key's rows the last by ``order`` counts."""
    one = lambda d, c: d.groupBy(key).agg(F.max_by(value, order).alias(c), F.lit(True).alias("_" + c))
    j = one(base, "before").join(one(current, "after"), key, "full_outer")
    kind = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "deleted").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    return j.withColumn("kind", kind).filter("kind is not null").select(key, "kind", "before", "after")


def replay_keyed(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` (key, value) after ``changes`` (key, seq, kind, after): each key's last change holds; one aggregation for the whole history."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("kind", "after"), "seq").alias("_c"))
    kept = base.join(last, key, "left_anti").select(key, "value")
    return kept.unionByName(last.filter("_c.kind <> 'deleted'").select(key, F.col("_c.after").alias("value")))


def patches(before: Column, after: Column) -> Column:
    """Of two arrays of one length: struct(index, value) where they differ."""
    both = F.zip_with(before, after, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.filter(F.transform(both, lambda s, i: F.when(~s.x.eqNullSafe(s.y), F.struct(i.alias("index"), s.y.alias("value")))), lambda s: s.isNotNull())


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, evaluated once: a column that an expression names several times is evaluated at each of the places."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _common(a: Column, b: Column) -> Column:
    def differ(s):
        n = F.least(F.size(s.a), F.size(s.b))
        first = F.array_position(F.zip_with(F.slice(s.a, 1, n), F.slice(s.b, 1, n), lambda x, y: x.eqNullSafe(y)), F.lit(False))
        return _once(first, lambda at: F.when(n == 0, 0).otherwise(F.when(at == 0, n).otherwise(at - 1)).cast("int"))

    return _once(F.struct(a.alias("a"), b.alias("b")), differ)


def _apart(a: Column, b: Column, f: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """``f`` of the common prefix's length, what follows it in ``a`` and in ``b``, and the length of these two's common suffix."""
    rest = lambda x, n: F.slice(x, n + 1, F.size(x) - n)
    rests = lambda s, n: F.struct(rest(s.a, n).alias("a"), rest(s.b, n).alias("b"))
    ends = lambda n, r: _once(_common(F.reverse(r.a), F.reverse(r.b)), lambda m: f(n, r.a, r.b, m))
    return _once(F.struct(a.alias("a"), b.alias("b")), lambda s: _once(_common(s.a, s.b), lambda n: _once(rests(s, n), lambda r: ends(n, r))))


def script(a: Column, b: Column) -> Column:
    """struct(prefix, replaced, removed, inserted): equal ends, then replacements in place, then what is left over."""

    def counts(prefix, rest_a, rest_b, suffix):
        na, nb = F.size(rest_a) - suffix, F.size(rest_b) - suffix
        return F.struct(prefix.alias("prefix"), F.least(na, nb).alias("replaced"), F.greatest(na - nb, F.lit(0)).alias("removed"), F.greatest(nb - na, F.lit(0)).alias("inserted"))

    return _apart(a, b, counts)


def edits(a: Column, b: Column) -> Column:
    """The script as a spliceable edit: struct(at, gone, put)."""
    middle = lambda x, suffix: F.slice(x, F.lit(1), F.size(x) - suffix)
    return _apart(a, b, lambda prefix, rest_a, rest_b, suffix: F.struct(prefix.alias("at"), middle(rest_a, suffix).alias("gone"), middle(rest_b, suffix).alias("put")))


def replay(a: Column, e: Column) -> Column:
    """``a`` after an edit; null if what it takes out isn't there."""

    def spliced(s):
        n = F.size(s.e["gone"])
        fits = F.slice(s.a, s.e["at"] + 1, n).eqNullSafe(s.e["gone"])
        return F.when(fits, F.concat(F.slice(s.a, F.lit(1), s.e["at"]), s.e["put"], F.slice(s.a, s.e["at"] + n + 1, F.size(s.a))))

    return _once(F.struct(a.alias("a"), e.alias("e")), spliced)


def members(before: DataFrame, after: DataFrame) -> DataFrame:
    """class, key, ord, kind, reason of (class, key, ord, text, markers, body): the first of signature, markers and body that differs.

    Overloads, members of one class and key, are paired by their order.
    """

    def side(d, c):
        ord_ = F.row_number().over(Window.partitionBy("class", "key").orderBy("ord"))
        return d.select("class", "key", ord_.alias("ord"), F.struct("text", "markers", "body").alias(c))

    j = side(before, "x").join(side(after, "y"), ["class", "key", "ord"], "full_outer")
    reason = F.when(~F.col("x.text").eqNullSafe(F.col("y.text")), "signature").when(~F.col("x.markers").eqNullSafe(F.col("y.markers")), "markers").when(~F.col("x.body").eqNullSafe(F.col("y.body")), "body")
    kind = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(reason.isNotNull(), "modified").otherwise("unchanged")
    return j.select("class", "key", "ord", kind.alias("kind"), F.when(kind == "modified", reason).alias("reason"))


def classes(changes: DataFrame) -> DataFrame:
    """class, added, removed, modified, unchanged, kind: a class is modified if a member changed."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    c = changes.groupBy("class").agg(n("added"), n("removed"), n("modified"), n("unchanged"))
    return c.withColumn("kind", F.when(F.col("added") + F.col("removed") + F.col("modified") > 0, "modified").otherwise("unchanged"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, status, old_path of two listings (path, hash): A, D, M, and R where a deleted and an added path share a hash.

    Of several paths of one hash the k-th added takes the k-th deleted, both in order.
    """
    j = before.withColumnRenamed("hash", "x").join(after.withColumnRenamed("hash", "y"), "path", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y")))
    numbered = lambda d, h: d.withColumn("_k", F.row_number().over(Window.partitionBy(h).orderBy("path")))
    gone = numbered(j.filter("y is null"), "x").select(F.col("path").alias("old_path"), F.col("x").alias("h"), "_k")
    new = numbered(j.filter("x is null"), "y").select("path", F.col("y").alias("h"), "_k")
    pairs = new.join(gone, ["h", "_k"], "full_outer")
    status = F.when(F.col("path").isNull(), "D").when(F.col("old_path").isNull(), "A").otherwise("R")
    moved = pairs.select(F.coalesce("path", "old_path").alias("path"), status.alias("status"), F.when(status == "R", F.col("old_path")).alias("old_path"))
    return moved.unionByName(j.filter("x is not null and y is not null").select("path", F.lit("M").alias("status"), F.lit(None).cast("string").alias("old_path")))


def overlapping(edits_df: DataFrame) -> DataFrame:
    """Pairs (file, a, b) of edits (file, id, start, stop) that overlap; a sweep by start looks at no other pairs than neighbours' runs."""
    w = Window.partitionBy("file").orderBy("start", "id").rowsBetween(Window.unboundedPreceding, -1)
    x = edits_df.withColumn("_far", F.max(F.struct("stop", "id")).over(w))
    return x.filter(F.col("_far.stop") > F.col("start")).select("file", F.col("_far.id").alias("a"), F.col("id").alias("b"))


def splice(text: Column, edits_: Column) -> Column:
    """``text`` after an array of struct(start, stop, put) of character places, from the last to the first."""
    order = F.reverse(F.array_sort(edits_))
    return F.aggregate(order, text, lambda t, e: F.concat(F.substring(t, F.lit(1), e.start), e.put, F.substring(t, e.stop + 1, F.length(t))))
