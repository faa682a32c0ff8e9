"""Query of the document fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchloom.llm import simhash
from pitchloom.llm.common import read


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(read(spark, sf_dir, "documents"))
