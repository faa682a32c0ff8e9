"""Query of the sequence packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchloom.llm import packing
from pitchloom.llm.common import read


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
