"""Query of the chat formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchloom.llm import chat
from pitchloom.llm.common import read, stored


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "cast(role as string) role", "cast(text as string) text")
    return chat.digests(stored(chat.format_windows(turns.union(probe), public_tokenizers.path("byte_bpe_50k.json")), "chat"))
