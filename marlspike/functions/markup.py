"""Column functions for style sheets and framework signs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# One pass, leftmost first, so that a name within a comment or a string isn't seen.
_SKIPPED = r"//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|\"(?s:\\.|[^\"\\])*(?:\"|\z)|'(?s:\\.|[^'\\])*(?:'|\z)"
_STYLE = _SKIPPED + r"|\.[A-Za-z][A-Za-z0-9_-]*|\$[A-Za-z][A-Za-z0-9_-]*|--[A-Za-z0-9_-]*|@[A-Za-z]+"

# At-rules that are listed.
AT_RULES = ["@include", "@mixin", "@import", "@use", "@forward"]

# Signs of the frameworks.
ANGULAR_STRONG = ["@Component(", "@Directive(", "@Injectable(", "@NgModule(", "@Pipe(", "@HostListener(", "@HostBinding(", "@ViewChild(", "@ViewChildren(", "@ContentChild(", "@ContentChildren("]
ANGULAR_IMPORT = "@angular/core"
ANGULAR_WEAK = ["@Input(", "@Input ", "@Output(", "@Output "]


def style_shape(css: Column) -> Column:
    """struct(classes, variables, at_rules) of a style sheet: classes and variables sorted and distinct, the listed at-rules by first sight.

    Null gives empty lists. The whole text is looked at.
    """
    found = F.regexp_extract_all(F.coalesce(css, F.lit("")), F.lit(_STYLE), F.lit(0))
    variable = lambda x: x.startswith("$") | (x.startswith("--") & (F.length(x) > 2))
    return F.struct(
        F.array_sort(F.array_distinct(F.filter(found, lambda x: x.startswith(".")))).alias("classes"),
        F.array_sort(F.array_distinct(F.filter(found, variable))).alias("variables"),
        F.array_distinct(F.filter(found, lambda x: x.isin(AT_RULES))).alias("at_rules"),
    )


def style_line(shape: Column) -> Column:
    """One line of a shape: 8 classes, 6 variables and 4 at-rules at most (the format's own limits)."""
    part = lambda name, most, sign: F.when(F.size(shape[name]) > 0, F.concat(F.lit(sign), F.array_join(F.slice(shape[name], 1, most), ",")))
    parts = F.concat_ws(" ", part("classes", 8, ""), part("variables", 6, "$"), part("at_rules", 4, "@"))
    return F.concat(F.lit("Φsty:"), F.when(parts == "", "empty").otherwise(parts))


def is_angular(source: Column) -> Column:
    """A strong decorator, or the core import with an input or output decorator."""
    has = lambda signs: reduce(or_, (source.contains(x) for x in signs))
    return has(ANGULAR_STRONG) | (source.contains(ANGULAR_IMPORT) & has(ANGULAR_WEAK))
