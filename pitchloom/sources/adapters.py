"""Carries generic tables to the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(events: DataFrame) -> DataFrame:
    """``clip_id, raga, frame_idx, f0, voiced``: a user is a clip; errors are unvoiced.

    Classes 0 to 5 go round the users; 6 and 7 have three users each at most.
    """
    order = W.partitionBy("clip_id").orderBy("ts", "event_id")
    rows = events.select(F.col("user_id").alias("clip_id"), "ts", "event_id", "value", (F.col("event_type") != "error").alias("voiced"))
    clip = F.col("clip_id")
    return rows.select(
        "clip_id",
        F.when(clip < 3, 6).when(clip < 6, 7).otherwise(clip % 6).cast("int").alias("raga"),
        (F.row_number().over(order) - 1).cast("long").alias("frame_idx"),
        F.when(F.col("voiced"), F.col("value") + 80).alias("f0"),
        "voiced",
    )


def vectors(embeddings: DataFrame) -> DataFrame:
    """``clip_id, raga, bin, p``: each vector shifted by its minimum and scaled to sum 1."""
    low = F.array_min("embedding").cast("double")
    shifted = F.transform("embedding", lambda x: x.cast("double") - low)
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    rows = embeddings.select(F.col("vec_id").alias("clip_id"), F.col("label").alias("raga"), shifted.alias("s"))
    rows = rows.withColumn("t", total)
    return rows.select("clip_id", "raga", "t", F.posexplode("s").alias("bin", "x")).select("clip_id", "raga", "bin", (F.col("x") / F.col("t")).alias("p"))


def symbols(conversations: DataFrame) -> DataFrame:
    """``clip_id, pos, symbol``: the roles of a conversation, in order."""
    return conversations.select(F.col("conv_id").alias("clip_id"), F.col("turn").alias("pos"), F.col("role").alias("symbol"))


def long_frames(clips: DataFrame) -> DataFrame:
    """Clip records with pitch arrays (``f0``, ``voiced_flag``; NaN is unvoiced) as rows of frames."""
    zipped = F.posexplode(F.arrays_zip("f0", "voiced_flag")).alias("frame_idx", "x")
    rows = clips.select("clip_id", "raga", zipped)
    f0 = F.col("x.f0")
    return rows.select("clip_id", "raga", F.col("frame_idx").cast("long").alias("frame_idx"), F.when(~F.isnan(f0), f0).alias("f0"), F.col("x.voiced_flag").alias("voiced"))
