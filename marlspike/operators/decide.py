"""File class, fidelity and cost decisions as ordered cases over one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# Thresholds, intents, and (overhead, ratio) by extension.
COMPLEX_IMPORTS, COMPLEX_FUNCTIONS, MEDIUM_LINES, HIGH_LINES = 15, 10, 300, 500
INTENTS = {"refactor": "High", "overview": "Low", "debug": "Medium", "edit": "Edit", "implement": "Medium"}
EDIT_COSTS = {"ts": (160.0, 0.25), "tsx": (160.0, 0.25), "js": (160.0, 0.25), "jsx": (160.0, 0.25), "cs": (180.0, 0.25), "rs": (150.0, 0.28), "java": (170.0, 0.30)}
OTHER_COST = (180.0, 0.20)
APPROXIMATE_BASIS_POINTS = 200


def signals(df: DataFrame, path: str, source: str) -> DataFrame:
    """``df`` with n_lines, imports, functions, types and tests of ``source``."""
    s = F.col(source)
    return df.withColumns({"n_lines": F.size(t.lines(s)), "imports": t.count_imports(s), "functions": t.count_functions(s), "types": t.count_types(s), "tests": t.count_tests(s)})


def file_class(path: Column) -> Column:
    """The class of a row with signals; the first case that holds decides."""
    n, i, f, s = (F.col(c) for c in ("n_lines", "imports", "functions", "types"))
    return (
        F.when((F.col("tests") > 0) | t.is_test_path(path), "Test").when(t.is_template_path(path), "Implementation").when(t.is_config_path(path), "Config")
        .when((n < 50) & (f == 0) & (s <= 1), "Config").when((s > 0) & (f == 0), "Model").when((s > f * 3) & (s >= 3), "Model")
        .when((i >= COMPLEX_IMPORTS) & (f >= COMPLEX_FUNCTIONS), "Service").when(t.is_implementation_path(path), "Implementation")
        .when((n > 200) & ((i > 0) | (f > 0) | (s > 0)), "Implementation").otherwise("General")
    )


def class_fidelity(cls: Column) -> Column:
    """Null for General, which complexity decides."""
    return F.when(cls.isin("Test", "Config"), "Low").when(cls.isin("Model", "Implementation"), "Medium").when(cls == "Service", "High")


def complexity_fidelity() -> Column:
    n, i, f = (F.col(c) for c in ("n_lines", "imports", "functions"))
    return F.when((i > 20) & (f > 15) & (n > HIGH_LINES), "High").when((i > 10) | (f > 10) | (n > MEDIUM_LINES), "Medium").otherwise("Low")


def fidelity(path: Column, explicit: Column | None = None, intent: Column | None = None, forced: dict[str, str] | None = None, stored: Column | None = None) -> Column:
    """explicit, intent, forced glob, stored, class, complexity: the first that says something."""
    null = F.lit(None).cast("string")
    by_glob = null
    for pattern, f in reversed(list((forced or {}).items())):
        by_glob = F.when(t.glob(path, pattern), f).otherwise(by_glob)
    wanted = null
    for k, f in INTENTS.items():
        wanted = F.when(intent == k, f).otherwise(wanted) if intent is not None else null
    return F.coalesce(explicit if explicit is not None else null, wanted, by_glob, stored if stored is not None else null, class_fidelity(file_class(path)), complexity_fidelity())


def worth_compressing(raw: Column, fid: Column, ext: Column) -> Column:
    """All but Edit always; Edit above 0.85 of overhead / ratio for the extension."""
    limit = F.lit(0.85 * (OTHER_COST[0] / OTHER_COST[1]))
    for e, (o, r) in EDIT_COSTS.items():
        limit = F.when(ext == e, F.lit(o / r * 0.85)).otherwise(limit)
    return (fid != "Edit") | (raw > limit)


def take_candidate(raw: Column, candidate: Column, tokenizer: Column) -> Column:
    """Exact counts: cheaper; approximate ones: cheaper by the error on both sides; of unknown confidence: never."""
    e = APPROXIMATE_BASIS_POINTS
    return F.when(tokenizer.isin("cl100k", "o200k"), candidate < raw).when(tokenizer == "claude", candidate * (10_000 + e) < raw * (10_000 - e)).otherwise(False)
