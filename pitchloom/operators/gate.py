"""The pitch stability gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchloom.params import Params


def gate(folded: DataFrame, p: Params = Params()) -> DataFrame:
    """``folded`` with ``kept``: whether a stable window covers the frame.

    A window of ``window`` frames is stable if enough of them are voiced and the
    means of its halves differ by less than ``drift``. Unvoiced frames count as 0
    cents and may be kept. The last possible window is not tried.
    """
    clip = W.partitionBy("clip_id").orderBy("frame_idx")
    w, half = p.window, p.window // 2
    rows = folded.withColumn("g", F.coalesce("cents", F.lit(0.0))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("clip_id")))
    ratio = F.avg(F.col("voiced").cast("double")).over(clip.rowsBetween(0, w - 1))
    drift = F.abs(F.avg("g").over(clip.rowsBetween(half, w - 1)) - F.avg("g").over(clip.rowsBetween(0, half - 1)))
    ok = (F.col("frame_idx") < F.col("n") - w) & (ratio >= p.voiced_ratio) & (drift < p.drift)
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)).cast("int"))
    kept = F.max("ok").over(clip.rowsBetween(-(w - 1), 0)) == 1
    return rows.withColumn("kept", kept).drop("ok", "n").withColumn("cents", F.col("g")).drop("g")


def ratios(gated: DataFrame, p: Params = Params(), gated_input: bool = True) -> DataFrame:
    """``clip_id, kept, voiced, gating_ratio``; without the gate, the share of voiced frames."""
    counts = gated.groupBy("clip_id").agg(F.sum(F.col("kept").cast("long")).alias("kept"), F.sum(F.col("voiced").cast("long")).alias("voiced"), F.count(F.lit(1)).alias("frames"))
    ratio = F.col("kept") / (F.col("voiced") + p.eps) if gated_input else F.col("voiced") / F.col("frames")
    return counts.select("clip_id", "kept", "voiced", ratio.alias("gating_ratio"))


def gated_cents(gated: DataFrame) -> DataFrame:
    """Only the kept frames, as training input."""
    return gated.where("kept").select("clip_id", "raga", "frame_idx", "cents")
