"""Source files: ignore-aware listing, hash gate against a previous snapshot, TOML rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension

# Supported extensions and directories that are never read.
SUPPORTED = ["ts", "tsx", "js", "jsx", "cs", "rs", "java", "html", "scss", "css", "json", "properties", "yml", "yaml"]
IGNORED = ["node_modules", "target", "dist", "build", "bin", "obj", ".git", "vendor"]


def scan(spark: SparkSession, root: str, mentions: str | None = None, most_bytes: int = 10_000_000) -> DataFrame:
    """path, source, hash of supported files under ``root``, optionally only those whose text mentions a name.

    The size limit and the path tests are applied before any content is decoded.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = raw.filter(F.col("length") <= most_bytes).filter(extension(F.col("path")).isin(SUPPORTED)).filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED))))
    out = kept.select("path", F.decode("content", "UTF-8").alias("source"), F.sha2("content", 256).alias("hash"))
    return out.filter(F.col("source").contains(mentions)) if mentions else out


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of ``now`` (path, hash, ...) that are new or whose hash differs."""
    return now.join(before.select("path", F.col("hash").alias("_old")), "path", "left").filter(~F.col("hash").eqNullSafe(F.col("_old"))).drop("_old")


def vanished(now: DataFrame, before: DataFrame) -> DataFrame:
    return before.join(now, "path", "left_anti")
