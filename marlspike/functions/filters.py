"""Declarative line filters compiled to one column each, their registry and selection.

Stages in order: ANSI, replace, collapse, keep or strip, group, head, tail, maximum, fallback. A collapse skips the stages
between. If a rule has keep patterns, its strip patterns don't apply.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import lines, strip_ansi, tokens_by_words


@dataclass(frozen=True)
class Group:
    key: str
    max_per_group: int
    max_groups: int
    omit_label: str = "... {n} more in {key}"


@dataclass(frozen=True)
class Rule:
    name: str
    command: str
    priority: int = 0
    strip_ansi: bool = False
    replace: tuple[tuple[str, str], ...] = ()
    collapse: tuple[tuple[str, str, str | None], ...] = ()  # pattern, message, unless
    keep: tuple[str, ...] = ()
    strip: tuple[str, ...] = ()
    group: Group | None = None
    head: int | None = None
    tail: int | None = None
    most: int | None = None
    on_empty: str | None = None
    tests: tuple[dict, ...] = field(default=(), hash=False)

    def errors(self) -> list[str]:
        """Patterns that don't compile."""
        found = []
        for p in (self.command, *self.keep, *self.strip, *(x[0] for x in self.replace), *(y for x in self.collapse for y in (x[0], x[2]) if y), *([self.group.key] if self.group else [])):
            try:
                re.compile(p)
            except re.error as e:
                found.append(f"{self.name}: {p}: {e}")
        return found


def load(text: str) -> list[Rule]:
    """Rules of a TOML text: a table for each filter, named by its key."""
    out = []
    for name, x in tomllib.loads(text).get("filters", {}).items():
        g = x.get("group_by")
        out.append(Rule(
            name, x.get("match_command", f"^{re.escape(name)}\\b"), x.get("priority", 0), x.get("strip_ansi", False),
            tuple((r["pattern"], r.get("replacement", "")) for r in x.get("replace", ())), tuple((m["pattern"], m["message"], m.get("unless")) for m in x.get("match_output", ())),
            tuple(x.get("keep_lines", ())), tuple(x.get("strip_lines", ())), Group(g["key"], g["max_per_group"], g["max_groups"], g.get("omit_label", Group.omit_label)) if g else None,
            x.get("head_lines"), x.get("tail_lines"), x.get("max_lines"), x.get("on_empty"), tuple(x.get("tests", ())),
        ))
    return out


def load_directory(folder: str) -> list[Rule]:
    """Rules of all TOML files of a folder, by file name; of rules of one name the later file's holds."""
    import pathlib

    by = {r.name: r for p in sorted(pathlib.Path(folder).glob("*.toml")) for r in load(p.read_text("utf-8"))}
    return list(by.values())


def apply_selected(rules: list[Rule], command: Column, s: Column) -> Column:
    """``s`` after the rule that its command selects; as it is where none does.

    The choice is the one ``select`` makes, in one expression on each row.
    """
    best = F.lit(None).cast("struct<n:int,p:int,r:string>")
    out = s
    for r in sorted(rules, key=lambda r: r.name, reverse=True):
        hit = F.when(command.rlike(r.command), F.struct(F.length(F.regexp_extract(command, f"({r.command})", 1)).alias("n"), F.lit(r.priority).alias("p"), F.lit(r.name).alias("r")))
        better = hit.isNotNull() & (best.isNull() | (hit.n > best.n) | ((hit.n == best.n) & (hit.p >= best.p)))
        best = F.when(better, hit).otherwise(best)
    for r in rules:
        out = F.when(best.r == r.name, apply(r, s).text).otherwise(out)
    return out


def _any(x: Column, patterns: tuple[str, ...]) -> Column:
    return x.rlike("|".join(f"(?:{p})" for p in patterns))


def _grouped(each: Column, g: Group) -> Column:
    """Lines by their group's first appearance, so many of each of so many groups, and a note of groups left out."""
    keyed = F.filter(F.transform(each, lambda x: F.struct(F.regexp_extract(x, g.key, 1).alias("k"), x.alias("x"), x.rlike(g.key).alias("ok"))), lambda s: s.ok)
    names = F.array_distinct(F.transform(keyed, lambda s: s.k))
    shown = F.flatten(F.transform(F.slice(names, 1, g.max_groups), lambda n: F.slice(F.transform(F.filter(keyed, lambda s: s.k == n), lambda s: s.x), 1, g.max_per_group)))
    note = F.replace(F.lit(g.omit_label.replace("{key}", "files")), F.lit("{n}"), (F.size(names) - g.max_groups).cast("string"))
    return F.when(F.size(names) > g.max_groups, F.concat(shown, F.array(note))).otherwise(shown)


def apply(rule: Rule, s: Column, failed: Column | None = None) -> Column:
    """struct(text, collapsed, truncated)."""
    failed = F.lit(False) if failed is None else failed
    cur = strip_ansi(s) if rule.strip_ansi else s
    for p, r in rule.replace:
        cur = F.array_join(F.transform(lines(cur), lambda x, p=p, r=r: F.regexp_replace(x, p, r)), "\n")
    message = F.lit(None).cast("string")
    for p, m, unless in reversed(rule.collapse):
        hit = cur.rlike(p) & (~cur.rlike(unless) if unless else F.lit(True)) & ~failed
        message = F.when(hit, F.lit(m)).otherwise(message)
    each = lines(cur)
    if rule.keep:
        each = F.filter(each, lambda x: _any(x, rule.keep))
    elif rule.strip:
        each = F.filter(each, lambda x: ~_any(x, rule.strip))
    if rule.group:
        each = _grouped(each, rule.group)
    cut = F.lit(False)
    for n, tail in ((rule.head, False), (rule.tail, True), (rule.most, False)):
        if n is not None:
            cut = cut | (F.size(each) > n)
            each = F.slice(each, F.greatest(F.size(each) - n + 1, F.lit(1)), n) if tail else F.slice(each, 1, n)
    cut = F.when(message.isNotNull(), False).otherwise(cut)
    touched = rule.keep or rule.strip or rule.group
    whole = F.array_join(each, "\n") if touched else F.when(cut, F.array_join(each, "\n")).otherwise(cur)
    out = F.coalesce(message, whole)
    if rule.on_empty is not None:
        out = F.when(F.trim(out, F.lit(" \t\r\n")) == "", rule.on_empty).otherwise(out)
    return F.struct(out.alias("text"), message.isNotNull().alias("collapsed"), cut.alias("truncated"))


def measured(before: Column, after: Column) -> Column:
    """struct(lines_before, lines_after, tokens_before, tokens_after, pct): the percentage may be negative."""
    a, b = tokens_by_words(before), tokens_by_words(after)
    pct = F.when(a > 0, F.round((a - b) * 100.0 / a, 4)).otherwise(F.lit(0.0))
    return F.struct(F.size(lines(before)).alias("lines_before"), F.size(lines(after)).alias("lines_after"), a.alias("tokens_before"), b.alias("tokens_after"), pct.alias("pct"))


def registry(builtin: list[Rule], community: list[Rule] = (), overrides: dict[str, bool] | None = None) -> list[Rule]:
    """Rules by name, the built-in before the community's; those an override disables go."""
    by = {r.name: r for r in (*community, *builtin)}
    return [r for n, r in sorted(by.items()) if (overrides or {}).get(n, True)]


def select(spark: SparkSession, commands: DataFrame, rules: list[Rule]) -> DataFrame:
    """``commands`` (command) with the name of its rule: longest match, then priority, then name; null if none matches.

    Rules are a few dozen literals, so the choice is an expression on each row and needs no join.
    """
    best = F.lit(None).cast("struct<n:int,p:int,r:string>")
    for r in sorted(rules, key=lambda r: r.name, reverse=True):
        m = F.regexp_extract(F.col("command"), f"({r.command})", 1)
        hit = F.when(F.col("command").rlike(r.command), F.struct(F.length(m).alias("n"), F.lit(r.priority).alias("p"), F.lit(r.name).alias("r")))
        better = hit.isNotNull() & (best.isNull() | (hit.n > best.n) | ((hit.n == best.n) & (hit.p >= best.p)))
        best = F.when(better, hit).otherwise(best)
    return commands.withColumn("rule", best.r)


def self_test(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """rule, test, passed: each rule's own tests (name, input, expected, failed) run as data."""
    out = None
    for r in rules:
        rows = [(t["name"], t["input"], t["expected"], t.get("failed", False)) for t in r.tests]
        if rows:
            df = spark.createDataFrame(rows, "test string, input string, expected string, failed boolean")
            one = df.select(F.lit(r.name).alias("rule"), "test", (apply(r, F.col("input"), F.col("failed")).text == F.col("expected")).alias("passed"))
            out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "rule string, test string, passed boolean")


def first_groups(lines_df: DataFrame, key: str, by: str, per_group: int, groups: int) -> DataFrame:
    """Rows of (by, pos, key): the first ``per_group`` of each of the first ``groups`` keys, by first appearance."""
    w = Window.partitionBy(by, key).orderBy("pos")
    x = lines_df.withColumn("_k", F.row_number().over(w)).withColumn("_first", F.min("pos").over(Window.partitionBy(by, key)))
    return x.withColumn("_g", F.dense_rank().over(Window.partitionBy(by).orderBy("_first"))).filter((F.col("_k") <= per_group) & (F.col("_g") <= groups)).drop("_k", "_first", "_g")
