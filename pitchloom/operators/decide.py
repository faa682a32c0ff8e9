"""From scores to a ranked label with a margin and a confidence tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchloom.params import UNKNOWN, Params


def rank(scores: DataFrame, key: str = "clip_id", ascending: bool = False) -> DataFrame:
    """``scores`` with ``rank``: best first, ties by class."""
    by = F.asc("score") if ascending else F.desc("score")
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(by, "model")))


def top(scores: DataFrame, k: int = 3, key: str = "clip_id") -> DataFrame:
    """A row per clip with ``top1`` to ``topk`` and their scores; missing ones are "" and 0."""
    ranked = rank(scores, key).where(F.col("rank") <= k)
    cols = []
    for i in range(1, k + 1):
        cols += [F.coalesce(F.max(F.when(F.col("rank") == i, F.col("model").cast("string"))), F.lit("")).alias(f"top{i}"), F.coalesce(F.max(F.when(F.col("rank") == i, F.col("score"))), F.lit(0.0)).alias(f"top{i}_score")]
    return ranked.groupBy(key).agg(*cols)


def tier(margin, p: Params = Params()):
    return F.when(margin >= p.margin_strict, "HIGH").when(margin >= p.margin_min, "MODERATE").otherwise("UNKNOWN")


def margins(scores: DataFrame, key: str = "clip_id") -> DataFrame:
    """``key, best, score, margin``: one aggregation that keeps the two best; a single class has margin 0."""
    pair = F.struct((-F.col("score")).alias("s"), F.col("model").alias("m"))
    best = scores.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(pair)), 1, 2).alias("t"))
    second = F.try_element_at("t", F.lit(2))
    return best.select(key, F.col("t")[0]["m"].alias("best"), (-F.col("t")[0]["s"]).alias("score"), F.coalesce(second["s"] - F.col("t")[0]["s"], F.lit(0.0)).alias("margin"))


def decisions(scores: DataFrame, clips: DataFrame | None = None, p: Params = Params(), key: str = "clip_id", ranking: bool = False) -> DataFrame:
    """``key, final, margin, confidence_tier`` (and ``ranking``) for every clip of ``clips``, also those without scores."""
    found = margins(scores, key)
    level = tier(F.col("margin"), p)
    out = found.select(key, F.when(level == "UNKNOWN", UNKNOWN).otherwise(F.col("best").cast("string")).alias("final"), "margin", level.alias("confidence_tier"))
    if ranking:
        order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "model"))), lambda x: F.struct(x["model"].cast("string").alias("raga"), (-x["s"]).alias("score")))
        out = out.join(scores.groupBy(key).agg(order.alias("ranking")), key)
    if clips is None:
        return out
    whole = clips.select(key).distinct().join(out, key, "left")
    whole = whole.withColumns({"final": F.coalesce("final", F.lit(UNKNOWN)), "margin": F.coalesce("margin", F.lit(0.0)), "confidence_tier": F.coalesce("confidence_tier", F.lit("UNKNOWN"))})
    return whole


def escalated(first: DataFrame, second: DataFrame, p: Params = Params()) -> DataFrame:
    """Decisions by ``first`` where its margin is strict, else by ``second`` (tier ESCALATED) where that suffices."""
    a, b = margins(first), margins(second).select("clip_id", F.col("best").alias("best2"), F.col("margin").alias("margin2"))
    rows = a.join(b, "clip_id", "left")
    strict, enough = F.col("margin") >= p.margin_strict, F.col("margin2") >= p.margin_min
    return rows.select(
        "clip_id",
        F.when(strict, F.col("best").cast("string")).when(enough, F.col("best2").cast("string")).otherwise(UNKNOWN).alias("final"),
        F.when(strict, F.col("margin")).otherwise(F.coalesce("margin2", F.lit(0.0))).alias("margin"),
        F.when(strict, "HIGH").when(enough, "ESCALATED").otherwise("UNKNOWN").alias("confidence_tier"),
    )


def distance_decisions(distances: DataFrame, close: float = 0.03, near: float = 0.06, key: str = "clip_id") -> DataFrame:
    """Decisions by distance, lower is better: unknown if the second is too near, or near with a near third."""
    ranked = rank(distances.withColumnRenamed("distance", "score"), key, ascending=True)
    at = lambda i: F.coalesce(F.max(F.when(F.col("rank") == i, F.col("score"))), F.lit(float("inf")))
    by = ranked.groupBy(key).agg(F.max(F.when(F.col("rank") == 1, F.col("model").cast("string"))).alias("best"), at(1).alias("d1"), at(2).alias("d2"), at(3).alias("d3"))
    m12 = F.col("d2") - F.col("d1")
    m23 = F.when(F.col("d3") == float("inf"), float("inf")).otherwise(F.col("d3") - F.col("d2"))
    unknown = (m12 < close) | ((m12 < near) & (m23 < close))
    return by.select(key, F.when(unknown, UNKNOWN).otherwise(F.col("best")).alias("final"), m12.alias("margin_12"), m23.alias("margin_23"))


def sibling_escalated(first: DataFrame, second: DataFrame, siblings: DataFrame, tie: float = 0.08, close: float = 0.03, near: float = 0.06) -> DataFrame:
    """Decisions by distance, where a tight call between siblings is made by the second distances.

    ``first`` and ``second`` have ``clip_id, model, distance``; ``siblings`` ``best,
    sibling`` rows. A clip goes over to ``second`` if the two nearest classes are less than
    ``tie`` apart and siblings.
    """
    ranked = rank(first.withColumnRenamed("distance", "score"), ascending=True).where("rank <= 2")
    at = lambda i, c: F.max(F.when(F.col("rank") == i, F.col(c)))
    heads = ranked.groupBy("clip_id").agg(at(1, "model").alias("best"), at(2, "model").alias("sibling"), (at(2, "score") - at(1, "score")).alias("m12"))
    over = heads.where(F.col("m12") < tie).join(F.broadcast(siblings), ["best", "sibling"], "left_semi").select("clip_id")
    rows = first.join(over, "clip_id", "left_anti").unionByName(second.join(over, "clip_id", "left_semi"))
    out = distance_decisions(rows, close, near)
    return out.join(over.withColumn("escalated", F.lit(True)), "clip_id", "left").withColumn("escalated", F.coalesce("escalated", F.lit(False)))


def top_bins(model: DataFrame, k: int = 10, digits: int = 9) -> DataFrame:
    """``raga, bin, rank``: each class's ``k`` fullest bins, ties (at so many digits) by bin."""
    order = W.partitionBy("raga").orderBy(F.desc(F.round("mean", digits)), "bin")
    return model.select("raga", "bin", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
