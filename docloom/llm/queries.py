"""The subpackage's queries, opN_<name> over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import oracles
from docloom.llm.ann import nearest
from docloom.llm.bitpack import packed_round_trip
from docloom.llm.decontaminate import decontaminate
from docloom.llm.html_extract import main_text
from docloom.llm.langid import language_of
from docloom.llm.language_model import score_documents
from docloom.llm.near_dedup import near_duplicates
from docloom.llm.packing import pack_documents
from docloom.llm.shared import table
from docloom.llm.substring_dedup import repeats
from docloom.llm.suffix_dedup import remove_repeats


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_language_id, op3_nearest_neighbours, op4_lm_scoring, op5_suffix_dedup, op6_main_text, op7_decontamination, op8_bit_packed_ids, op9_substring_dedup, op10_packing)}


def oracle_sql() -> dict[str, str]:
    """Windows and links that SQL can state; models, tokenizers, pages and approximate search it cannot."""
    return {
        "op1_near_dedup": oracles.NEAR_DEDUP,
        "op5_suffix_dedup": oracles.SUFFIX_DEDUP,
        "op7_decontamination": oracles.DECONTAMINATION,
        "op9_substring_dedup": oracles.SUBSTRING_DEDUP,
    }
