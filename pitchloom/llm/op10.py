"""Query of the secret scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchloom.llm import secrets
from pitchloom.llm.common import read


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(read(spark, sf_dir, "documents")))
