"""Query of the alignment of two tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchloom.llm import alignment
from pitchloom.llm.common import read


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
