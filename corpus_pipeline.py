"""Corpus pipeline: documents to packed sequences in five stages, each over all that the one before it kept.

1. toxicity: documents that the factorization machine, fitted on all labels, rejects go.
2. line_dedup: lines that many sites share go from the texts.
3. near_duplicates: of each component of the n-gram Jaccard join (five words, 0.8) the document with the smallest id stays.
4. decontamination: documents with a window that resembles a benchmark item go.
5. packing: the texts are tokenized and packed; one row per piece.

Stages 1 to 4 return the columns of documents, whatever these are called. Null and empty texts pass through all of them and
are packed as an end id. Repeated rows and rows that share an id are each judged, and copies leave one row; rows without an id
stay in stage 3, as no smaller id can be named. Ties are settled as each operator says. An empty table gives an empty
result, and without labels or benchmark items nothing is rejected on their account.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from marlspike.llm.common import stored, table
from marlspike.llm.queries import vocabulary_file


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.strip(docs, line_dedup.boilerplate(docs))
    # n_chars says the length of the text that is left.
    n_chars = F.when(F.col("_ld_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.op1(docs, vocabulary_file("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", reject_contaminated),
    ("packing", pack),
]

#: The machine of the first stage can't be expressed in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
