"""Queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitchloom.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13
from pitchloom.llm.common import known_to_workers

QUERIES = {
    "op1_pfor_token_ids": op1,
    "op2_nn_descent": op2,
    "op3_simhash": op3,
    "op4_divide_skip": op4,
    "op5_level_doubling": op5,
    "op6_pattern_packing": op6,
    "op7_language_bitmask": op7,
    "op8_chat_windows": op8,
    "op9_bpe_automaton": op9,
    "op10_secret_links": op10,
    "op11_phrase_bitmaps": op11,
    "op12_token_links": op12,
    "op13_winnowing": op13,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def with_package(run):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            known_to_workers(spark)
            return run(spark, sf_dir)

        return query

    return {name: with_package(module.run) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in QUERIES.items() if getattr(module, "ORACLE_SQL", None)}
