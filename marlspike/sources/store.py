"""Persisted relations as Parquet tables partitioned by a bucket of the file, rewritten bucket by bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import latest

BUCKETS = 64


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))


class Store:
    """Contexts of files. A save replaces all rows of the files it holds; other buckets aren't touched."""

    def __init__(self, spark: SparkSession, path: str, key: str = "file_path"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def read(self) -> DataFrame | None:
        """The table, or None where its folder doesn't exist; any other fault is the caller's to see."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(self.path) if there else None

    def _write(self, df: DataFrame) -> None:
        # The new rows are settled in a folder beside the table before its buckets are overwritten.
        staged = f"{self.path}__staged"
        df.write.mode("overwrite").parquet(staged)
        self.spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)

    def save(self, rows: DataFrame) -> None:
        new = _bucketed(rows, self.key)
        old = self.read()
        if old is not None:
            touched = new.select("_bucket").distinct()
            kept = old.join(F.broadcast(touched), "_bucket", "left_semi").join(new.select(self.key).distinct(), self.key, "left_anti")
            new = new.unionByName(kept, allowMissingColumns=True)
        self._write(new)

    def delete(self, files: DataFrame) -> None:
        old = self.read()
        if old is not None:
            # A bucket that loses all its rows has none to overwrite it with, so the whole table is written again.
            kept = old.join(files.select(self.key).distinct(), self.key, "left_anti")
            staged = f"{self.path}__staged"
            kept.write.mode("overwrite").parquet(staged)
            self.spark.read.schema(old.schema).parquet(staged).write.mode("overwrite").partitionBy("_bucket").parquet(self.path)

    def load_latest(self) -> DataFrame | None:
        """The newest context of each file; None while nothing was ever saved."""
        rows = self.read()
        return None if rows is None else latest(rows.drop("_bucket"), self.key, ["updated_at"])


def sink(store: Store):
    """For foreachBatch: a batch that comes again replaces its files with the same rows."""
    return lambda df, _batch_id: store.save(df)
