"""Query of the token-id files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchloom.llm import pfor
from pitchloom.llm.common import read, shared_path


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-ids")
    pfor.write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return pfor.read_digests(spark, path)
