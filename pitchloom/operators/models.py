"""Class models: mean histograms and transitions, and the weights made from them.

Histograms of classes are dense (a row per class and bin, some hundreds); those of
clips and all transition counts stay sparse. A mean transition matrix is kept as
the sums of its clips' counts over their normalisers, with two scalars that stand
for the smoothing of every cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchloom.params import Params


def clip_counts(pcd: DataFrame) -> DataFrame:
    """``raga, clip_count``."""
    return pcd.groupBy("raga").agg(F.count_distinct("clip_id").alias("clip_count"))


def eligible(counts: DataFrame, p: Params = Params()) -> DataFrame:
    return counts.where(F.col("clip_count") >= p.min_clips)


def excluded(counts: DataFrame, p: Params = Params()) -> DataFrame:
    """Classes with too few clips, and how many they lack."""
    return counts.where(F.col("clip_count") < p.min_clips).withColumn("deficit", p.min_clips - F.col("clip_count"))


def guarded(clips: DataFrame, p: Params = Params(), version: str | None = None, min_frames: int | None = None) -> DataFrame:
    """Clip records fit for use: feature version, gating ratio and, for evaluation, number of frames."""
    out = clips.where((F.col("feature_version") == (version or p.feature_version)) & (F.col("gating_ratio") >= p.min_gating))
    return out.where(F.col("frames") >= min_frames) if min_frames else out


def guard_counts(clips: DataFrame, p: Params = Params()) -> DataFrame:
    """Files seen and skipped, by reason; a missing version is skipped like a wrong one."""
    wrong = ~F.col("feature_version").eqNullSafe(p.feature_version)
    weak = ~wrong & (F.col("gating_ratio") < p.min_gating)
    return clips.agg(F.count(F.lit(1)).alias("total_files_seen"), F.count_if(wrong).alias("skipped_version"), F.count_if(weak).alias("skipped_gating"), F.count_if(wrong | weak).alias("skipped_files"))


def grid(counts: DataFrame, p: Params) -> DataFrame:
    """Every class with every bin."""
    return counts.select("raga", "clip_count", F.explode(F.sequence(F.lit(0), F.lit(p.n_bins - 1))).alias("bin"))


def models(pcd: DataFrame, p: Params = Params()) -> DataFrame:
    """``raga, bin, mean, std, clip_count`` of the eligible classes, dense over the bins.

    Bins that a clip lacks count as 0. The deviation is that of the population,
    summed around the mean.
    """
    counts = eligible(clip_counts(pcd), p)
    sums = pcd.groupBy("raga", "bin").agg(F.sum("p").alias("s"))
    mean = F.coalesce(F.col("s") / F.col("clip_count"), F.lit(0.0))
    dense = grid(counts, p).join(sums, ["raga", "bin"], "left").withColumn("mean", mean)
    return dense.select("raga", "bin", "mean", "clip_count").join(_spread(pcd, dense), ["raga", "bin"])


def _spread(pcd: DataFrame, dense: DataFrame) -> DataFrame:
    """``raga, bin, std``: squares around the mean, plus those of the clips that lack the bin."""
    means = dense.select("raga", "bin", "mean", "clip_count")
    off = pcd.join(F.broadcast(means), ["raga", "bin"]).groupBy("raga", "bin").agg(F.sum((F.col("p") - F.col("mean")) ** 2).alias("q"), F.count(F.lit(1)).alias("seen"))
    q = F.coalesce("q", F.lit(0.0)) + (F.col("clip_count") - F.coalesce("seen", F.lit(0))) * F.col("mean") ** 2
    return means.join(off, ["raga", "bin"], "left").select("raga", "bin", F.sqrt(q / F.col("clip_count")).alias("std"))


def class_means(clips: DataFrame, values: list[str]) -> DataFrame:
    """Mean of scalar columns by class, over its clips."""
    return clips.groupBy("raga").agg(*[F.avg(v).alias(f"mean_{v}") for v in values])


def renormalised(model: DataFrame, p: Params = Params()) -> DataFrame:
    """Variant: each class's mean histogram scaled to sum 1."""
    return model.withColumn("mean", F.col("mean") / (F.sum("mean").over(W.partitionBy("raga")) + p.eps))


def weights(model: DataFrame, p: Params = Params(), kind: str = "idf_variance", keys: tuple[str, ...] = ()) -> DataFrame:
    """``bin, weight`` (by ``keys``, if given) from dense class means.

    * ``idf_variance``: ``(ln(n / (df + 1)) + 1) / (std + eps)``, scaled to sum ``n_bins``;
      ``df`` counts the classes above ``1 / n_bins``, ``std`` is over the classes;
    * ``idf``: its first factor alone;
    * ``whiten``: ``1 / (std + eps)``;
    * ``idf_old``: ``ln(n / (df + 1)) / (std + eps)``, ``df`` above 0.001, scaled.
    """
    level = 0.001 if kind == "idf_old" else 1.0 / p.n_bins
    by = model.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("mean") > level).cast("int")).alias("df"), F.stddev_pop("mean").alias("sd"))
    idf = F.ln(F.col("n") / (F.col("df") + 1)) + (0 if kind == "idf_old" else 1)
    raw = {"idf": idf, "whiten": 1 / (F.col("sd") + p.eps)}.get(kind, idf / (F.col("sd") + p.eps))
    by = by.select(*keys, "bin", raw.alias("weight"))
    if kind in ("idf", "whiten"):
        return by
    # Without keys the window has one row per bin.
    return by.withColumn("weight", F.col("weight") / (F.sum("weight").over(W.partitionBy(*keys)) + p.eps) * p.n_bins)


def dyad_models(counts: DataFrame, totals: DataFrame, clip_counts_: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Cells ``raga, dir, frm, to, m`` and scalars ``raga, dir, u, v`` of the mean transition matrices.

    A cell of the mean is ``m + alpha * u``; ``u`` and ``v`` are the means over the
    class's clips of ``1 / z`` and ``s / z``, clips without a matrix counting 0.
    """
    n = F.broadcast(eligible(clip_counts_, p))
    scaled = counts.join(totals.select("clip_id", "dir", "z"), ["clip_id", "dir"])
    cells = scaled.groupBy("raga", "dir", "frm", "to").agg(F.sum(F.col("cnt") / F.col("z")).alias("x")).join(n, "raga").select("raga", "dir", "frm", "to", (F.col("x") / F.col("clip_count")).alias("m"))
    sums = totals.groupBy("raga", "dir").agg(F.sum(1 / F.col("z")).alias("u"), F.sum(F.col("s") / F.col("z")).alias("v")).join(n, "raga")
    return cells, sums.select("raga", "dir", (F.col("u") / F.col("clip_count")).alias("u"), (F.col("v") / F.col("clip_count")).alias("v"))


def mean_shares(counts: DataFrame, eligible_: DataFrame, keys: list[str]) -> DataFrame:
    """``model, *keys, m``: by class, the mean over its clips of their counts scaled to sum 1, without smoothing.

    ``counts`` has ``clip_id, raga, *keys, cnt``; clips without a count do not count.
    """
    shares = counts.withColumn("x", F.col("cnt") / F.sum("cnt").over(W.partitionBy("clip_id")))
    clips = counts.groupBy("raga").agg(F.count_distinct("clip_id").alias("k"))
    sums = shares.groupBy("raga", *keys).agg(F.sum("x").alias("x")).join(F.broadcast(clips), "raga").join(F.broadcast(eligible_.select("raga")), "raga", "left_semi")
    return sums.select(F.col("raga").alias("model"), *keys, (F.col("x") / F.col("k")).alias("m"))


def run_metadata(pcd: DataFrame, guards: DataFrame, run_id: str, source: str, p: Params = Params()) -> DataFrame:
    """One row on an aggregation run."""
    counts = clip_counts(pcd)
    ex = excluded(counts, p).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("raga").cast("string"), "clip_count")))).alias("excluded_ragas"))
    inc = eligible(counts, p).agg(F.array_sort(F.collect_list(F.col("raga").cast("string"))).alias("included_ragas"), F.sum("clip_count").alias("included_clips"))
    fixed = [F.lit(p.feature_version).alias("feature_version"), F.lit(p.n_bins).alias("bins"), F.lit(p.min_stable).alias("min_stable_frames"), F.lit(p.alpha).alias("alpha"), F.lit(run_id).alias("timestamp"), F.lit(source).alias("feature_source"), F.lit(p.min_clips).alias("min_clips_per_raga")]
    return guards.select(*fixed, "total_files_seen", "skipped_files").crossJoin(ex).crossJoin(inc)  # one row each
