"""Query of the nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchloom.llm import neighbours
from pitchloom.llm.common import read


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), every=100, k=10)
