"""The thin queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat_format, decontaminate, language_id, line_dedup, lm_scoring, ngram_join, packing, suffix_dedup, toxicity
from .common import table


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": lambda s, d: packing.op1(table(s, d, "documents"), vocabulary_file("word_bpe_49k.json")),
        "op2_benchmark_decontamination": lambda s, d: decontaminate.matches(table(s, d, "documents"), table(s, d, "benchmark")),
        "op3_suffix_array_dedup": lambda s, d: suffix_dedup.op3(table(s, d, "documents")),
        "op4_lm_scoring": lambda s, d: lm_scoring.op4(table(s, d, "documents"), vocabulary_file("piece_bpe_32k.model")),
        "op5_chat_formatting": lambda s, d: chat_format.op5(table(s, d, "conversations"), vocabulary_file("byte_bpe_50k.tiktoken")),
        "op6_line_dedup": lambda s, d: line_dedup.op6(table(s, d, "documents")),
        "op7_ngram_jaccard_join": lambda s, d: ngram_join.op7(table(s, d, "documents")),
        "op8_nearest_neighbours": lambda s, d: ann.op8(table(s, d, "embeddings")),
        "op9_toxicity": lambda s, d: toxicity.op9(table(s, d, "documents"), table(s, d, "labels")),
        "op10_language_id": lambda s, d: language_id.op10(table(s, d, "documents")),
        "pipeline": _pipeline,
    }


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": line_dedup.op6_sql()}
