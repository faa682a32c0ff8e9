"""Query of the tokenization automaton."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchloom.llm import automaton
from pitchloom.llm.common import read


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return automaton.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
