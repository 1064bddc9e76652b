"""Column functions for compact text: control markers, micro opcodes, headers, dictionary footers, language guesses, JSON with short keys."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Markers and what they read as.
MARKERS = {"⊕guard": "", "⊕loop": "", "⊕⇒": "→ ", "⊕!": "throws: "}

# Micro opcodes, in the order in which they are replaced.
MICRO = [("{", "§C"), ("}", "§C"), ("$ctor", "§P"), ("⊕guard", "§I"), ("⊕loop", "§L"), ("⊕⇒", "§E")]

# Short names of JSON keys.
SHORT_KEYS = {
    "results": "r", "symbols": "s", "edges": "e", "nodes": "n", "name": "nm", "file": "f", "label": "l", "id": "i", "score": "sc", "importance": "im",
    "reason": "rn", "modules": "m", "dependencies": "d", "kind": "k", "properties": "p", "from": "fr", "to": "t", "changes": "c", "graph_version": "gv",
    "impact": "ip", "symbol": "sy", "change_type": "ct", "query": "q", "project": "pj", "arguments": "a", "content": "ct", "type": "tp", "text": "tx",
    "description": "dsc", "status": "st", "error": "e", "message": "msg", "code": "cd", "jsonrpc": "jrpc", "method": "mth", "params": "prm", "result": "res",
    "path": "pth", "file_count": "fc", "matched_symbols": "ms", "is_direct": "dir", "data": "d",
}

# What shows a language.
CSHARP = ["namespace ", "using System", "public class ", "private void "]
RUST_STRONG = ["impl ", "trait "]
RUST_WEAK = ["fn ", "struct ", "enum ", "use ", "mod "]
JAVA_STRONG = ["package ", "import java.", "import javax.", "import jakarta.", "import org.springframework", "@Override"]
JAVA_WEAK = ["interface ", "class ", "public ", "private ", "protected ", "extends ", "implements "]


def _replaced(s: Column, pairs) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, s)


def _any(s: Column, signs: list[str]) -> Column:
    return reduce(or_, (s.contains(x) for x in signs))


def _count(s: Column, signs: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (s.contains(x).cast("int") for x in signs))


def control_marker(capture: Column, text: Column) -> Column:
    """Marker of a control-flow capture; null for any other capture."""
    return (
        F.when(capture == "throw.root", F.concat(F.lit("⊕!"), text)).when(capture == "return.root", F.concat(F.lit("⊕⇒"), text))
        .when(capture.isin("for.root", "while.root"), "⊕loop").when(capture == "if.root", "⊕guard")
    )


def expand_markers(line: Column) -> Column:
    return _replaced(line, MARKERS.items())


def micro_opcodes(body: Column, fidelity: Column) -> Column:
    """Opcodes at low fidelity alone. Both braces become one opcode, so it can't be undone."""
    return F.when(F.lower(fidelity) == "low", _replaced(body, MICRO)).otherwise(body)


def savings_text(pct: Column) -> Column:
    """At most one decimal, none where the number is whole."""
    return F.when(pct == F.floor(pct), F.format_string("%.0f", pct)).otherwise(F.format_string("%.1f", pct))


def compact_header(raw: Column, compressed: Column, pct: Column, classes: Column, methods: Column, imports: Column) -> Column:
    n = lambda c: c.cast("string")
    return F.concat(F.lit("§"), F.concat_ws(":", n(raw), n(compressed), savings_text(pct)), F.lit("|L|"), F.concat_ws(":", n(classes), n(methods), n(imports)), F.lit("§"))


def cache_hit(raw: Column, compressed: Column, pct: Column, alias: Column) -> Column:
    head = F.concat_ws(":", raw.cast("string"), compressed.cast("string"), savings_text(pct))
    return F.concat(F.lit("§"), head, F.lit("|C|"), alias, F.lit("§\n// [CACHE_HIT] "), alias, F.lit(" unchanged. Use historic memory.\n"))


def parse_header(line: Column) -> Column:
    """struct(raw, compressed, pct, classes, methods, imports) of a header, or null where ``line`` is none. The middle part isn't looked at."""
    pattern = r"^§(\d+):(\d+):(-?\d+(?:\.\d+)?)\|[^|]*\|(\d+):(\d+):(\d+)§$"
    s = F.trim(line)
    names = [("raw", "long"), ("compressed", "long"), ("pct", "double"), ("classes", "long"), ("methods", "long"), ("imports", "long")]
    return F.when(s.rlike(pattern), F.struct(*(F.regexp_extract(s, pattern, i + 1).try_cast(t).alias(n) for i, (n, t) in enumerate(names))))


def footer(title: str, pairs: Column) -> Column:
    """Section of ``pairs``, an array of struct(alias, value), one a line in the array's order."""
    lines = F.transform(pairs, lambda p: F.concat(F.lit("  "), p["alias"], F.lit(" = "), p["value"], F.lit("\n")))
    return F.concat(F.lit(f"§{title}\n"), F.array_join(lines, ""))


def symbol_footer(pairs: Column, builtin: Column) -> Column:
    """Footer of the aliases that aren't in ``builtin``, an array; empty if there are none, or if the dictionary (``pairs``) has more than 32 entries."""
    own = F.filter(pairs, lambda p: ~F.array_contains(builtin, p["alias"]))
    return F.when((F.size(pairs) > 32) | (F.size(own) == 0), "").otherwise(footer("SYM", own))


def looks_like_csharp(s: Column) -> Column:
    return _any(s, CSHARP)


def looks_like_rust(s: Column) -> Column:
    """A strong sign, or two weak ones."""
    public = (s.contains("pub ") | s.contains("pub(")).cast("int")
    return _any(s, RUST_STRONG) | (_count(s, RUST_WEAK) + public >= 2)


def looks_like_java(s: Column) -> Column:
    """A strong sign or three weak ones, unless arrows without ``->``, an export or a first import with a brace speak for TypeScript."""
    first_import = F.regexp_extract(s, r"(?m)^[^\S\n]*(import [^\n]*)", 1)
    other = (s.contains("=>") & ~s.contains("->")) | s.contains("export ") | (first_import.contains("{") & ~first_import.contains("static "))
    return ~other & (_any(s, JAVA_STRONG) | (_count(s, JAVA_WEAK) >= 3))


def language_of(s: Column) -> Column:
    """First language whose signs are there, TypeScript else; null text gives null."""
    guess = F.when(looks_like_csharp(s), "csharp").when(looks_like_rust(s), "rust").when(looks_like_java(s), "java").otherwise("typescript")
    return F.when(s.isNotNull(), guess)


def _short(v) -> str:
    if isinstance(v, dict):
        each = ((SHORT_KEYS.get(k, k), _short(x)) for k, x in sorted(v.items()))
        return "\n".join(f"{k}:{x}" for k, x in each if x)
    if isinstance(v, list):
        each = [x for x in map(_short, v) if x]
        return (" " if len(each) <= 3 else "\n").join(each)
    if isinstance(v, str):
        return v.strip()
    return "" if v is None else json.dumps(v)


def _json_or_stripped(s: str | None) -> str | None:
    if s is None:
        return None
    try:
        return _short(json.loads(s))
    except (ValueError, RecursionError):
        return "".join(c for c in s if c in " \n" or not c.isspace())


@F.pandas_udf(StringType())
def short_json(s: pd.Series) -> pd.Series:
    """JSON as ``key:value`` lines with short keys, in order of the keys, without nulls and empty values; up to three array entries share a line.

    Other text loses white space but spaces and newlines. JSON is a tree of any depth, so this is an Arrow function.
    """
    return s.map(_json_or_stripped, na_action=None)
