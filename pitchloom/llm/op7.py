"""Query of the language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchloom.llm import langid
from pitchloom.llm.common import read


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    learned = langid.fit(docs.where(~langid.held_out(docs)))
    return langid.predict(docs.select("doc_id", langid.held_out(docs).alias("held_out"), "text"), learned).select("doc_id", "held_out", "lang_pred", "score")
