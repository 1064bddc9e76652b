"""What an index can answer for, and which stored results still hold: evidence, projections, discovery, publication, compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import admits, is_identity

#: Fidelities from least to most, and the names of what makes a stored context unfit.
FIDELITIES = ["low", "medium", "high", "edit", "verbatim"]
COMPONENTS = ["canonical_configuration", "semantic_configuration", "canonical_producers", "semantic_producers"]


def rank(fidelity: Column) -> Column:
    """Place among the fidelities, from 0; null for any other name."""
    at = F.array_position(F.array(*map(F.lit, FIDELITIES)), fidelity)
    return F.when(at > 0, at - 1)


def _any(rows: DataFrame, hit: Column, name: str) -> DataFrame:
    return rows.agg(F.coalesce(F.max(hit), F.lit(False)).alias(name))


def has_identity(entities: DataFrame, domain: str, entity_type: str, name: str, roots: list[str] | None = None) -> DataFrame:
    return _any(entities, is_identity(domain, entity_type, name) & admits(F.col("file"), roots or []), "covered")


def adjacency(edges: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """domain, entity_type, forward, backward: which kinds of entity have any outgoing and any incoming edge in scope."""
    e = edges.filter(admits(F.col("asserting_file"), roots or []))
    side = lambda d, t, f: e.select(F.col(d).alias("domain"), F.col(t).alias("entity_type"), F.lit(f).alias("f"))
    both = side("s_domain", "s_type", True).unionByName(side("o_domain", "o_type", False))
    return both.groupBy("domain", "entity_type").agg(F.max("f").alias("forward"), F.max(~F.col("f")).alias("backward"))


def is_current(wanted: DataFrame, projections: DataFrame) -> DataFrame:
    """``wanted`` (file, hash, fidelity) with current: the file's projection has that hash and that fidelity at least."""
    p = projections.select("file", F.col("hash").alias("_h"), F.col("fidelity").alias("_f"))
    ok = F.col("_h").eqNullSafe(F.col("hash")) & (rank(F.col("_f")) >= rank(F.col("fidelity")))
    return wanted.join(p, "file", "left").withColumn("current", F.coalesce(ok, F.lit(False))).drop("_h", "_f")


def replaced(rows: DataFrame, file_col: str, new: DataFrame) -> DataFrame:
    """``rows`` in which the files that ``new`` speaks for have its rows only: one plan, so readers see all of it or none."""
    return rows.join(new.select(file_col).distinct(), file_col, "left_anti").select(*new.columns).unionByName(new)


def complete(completed: DataFrame, generations: DataFrame) -> DataFrame:
    """Discoveries (scope, mode, name, fidelity, generation) with complete: recorded in their scope's newest generation (scope, generation)."""
    now = generations.groupBy("scope").agg(F.max("generation").alias("_g"))
    last = completed.groupBy("scope", "mode", "name", "fidelity").agg(F.max("generation").alias("generation"))
    return last.join(now, "scope", "left").withColumn("complete", F.col("generation") == F.coalesce("_g", F.lit(0))).drop("_g")


def publishable(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Compiled candidates (file, hash, ...) whose source (file, hash) hasn't changed since; others have to be compiled again."""
    return candidates.join(sources.select("file", F.col("hash").alias("_h")), "file", "left").withColumn("fresh", F.coalesce(F.col("hash") == F.col("_h"), F.lit(False))).drop("_h")


def failure(stored: str = "stored", current: str = "current") -> Column:
    """Why a stored context (struct: hash, fidelity, the four components) doesn't serve the current one; null if it does."""
    s, c = (lambda n: F.col(f"{stored}.{n}")), (lambda n: F.col(f"{current}.{n}"))
    out = F.when(~s("hash").eqNullSafe(c("hash")), "source_mismatch").when(rank(s("fidelity")) < rank(c("fidelity")), "insufficient_fidelity")
    for n in COMPONENTS:
        out = out.when(s(n).isNull(), "missing_legacy_identity")
    for n in COMPONENTS:
        what = n.replace("producers", "producer")
        out = out.when(s(n) != c(n), f"{what}_incompatible")
    return out


def unchanged(files: DataFrame, versions: DataFrame) -> DataFrame:
    """``files`` (file, hash) with version and same: whether the hash last recorded for the file (file, seq, hash, version) is this one."""
    last = versions.groupBy("file").agg(F.max_by(F.struct("hash", "version"), "seq").alias("_l"))
    return files.join(last, "file", "left").select(*files.columns, F.col("_l.version").alias("version"), F.coalesce(F.col("_l.hash") == F.col("hash"), F.lit(False)).alias("same"))
