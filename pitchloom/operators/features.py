"""Histograms, stable runs and directed transitions of folded pitch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchloom.functions import pitch
from pitchloom.params import Params

KEYS = ("clip_id", "raga")


def histogram(folded: DataFrame, p: Params = Params(), eps: float = 0.0) -> DataFrame:
    """``clip_id, raga, bin, p``: share of the frames in each bin that has any (training adds ``eps`` to the sum)."""
    counts = folded.where(F.col("cents").isNotNull()).groupBy(*KEYS, pitch.histogram_bin(F.col("cents"), p.n_bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return counts.select(*KEYS, "bin", (F.col("c") / (F.sum("c").over(W.partitionBy("clip_id")) + eps)).alias("p"))


def binned(folded: DataFrame, p: Params = Params()) -> DataFrame:
    """``clip_id, raga, pos, bin``: frames within the range, numbered anew."""
    rows = folded.select(*KEYS, "frame_idx", pitch.digitised_bin(F.col("cents"), p.n_bins).alias("bin")).where(F.col("bin").isNotNull())
    return rows.select(*KEYS, (F.row_number().over(W.partitionBy("clip_id").orderBy("frame_idx")) - 1).cast("long").alias("pos"), "bin")


def runs(bins: DataFrame) -> DataFrame:
    """``clip_id, raga, run, bin, len, first``: runs of equal neighbours, numbered in order; one sort of the clip."""
    clip = W.partitionBy("clip_id").orderBy("pos")
    turn = bins.withColumn("t", F.coalesce(F.lag("bin").over(clip) != F.col("bin"), F.lit(True)).cast("int")).withColumn("run", F.sum("t").over(clip))
    return turn.groupBy(*KEYS, "run").agg(F.first("bin").alias("bin"), F.count(F.lit(1)).alias("len"), F.min("pos").alias("first"))


def stable(all_runs: DataFrame, p: Params = Params()) -> DataFrame:
    return all_runs.where(F.col("len") >= p.min_stable)


def _directed(rows: DataFrame, frm: str, to: str) -> DataFrame:
    way = F.when(F.col(to) > F.col(frm), "up").when(F.col(to) < F.col(frm), "down")
    return rows.select(*KEYS, way.alias("dir"), F.col(frm).alias("frm"), F.col(to).alias("to")).where(F.col("dir").isNotNull())


def transitions(all_runs: DataFrame, p: Params = Params(), variant: str = "stable") -> DataFrame:
    """``clip_id, raga, dir, frm, to``: a row per transition.

    * ``stable``: between consecutive stable runs, whatever lies between;
    * ``into``: from the frame before a stable run into it;
    * ``out_of``: from a stable run to the frame behind it (``dir`` is ``any``);
    * ``frames``: between all neighbouring frames, also equal ones (``any``), which
      counts a run's inner steps.
    """
    clip = W.partitionBy("clip_id").orderBy("run")
    if variant == "stable":
        return _directed(stable(all_runs, p).withColumn("to", F.lead("bin").over(clip)), "bin", "to")
    if variant == "into":
        return _directed(all_runs.withColumn("frm", F.lag("bin").over(clip)).where(F.col("len") >= p.min_stable), "frm", "bin")
    if variant == "out_of":
        rows = all_runs.withColumn("to", F.lead("bin").over(clip)).where((F.col("len") >= p.min_stable) & F.col("to").isNotNull())
        return rows.select(*KEYS, F.lit("any").alias("dir"), F.col("bin").alias("frm"), "to")
    raise ValueError(variant)


def frame_transitions(bins: DataFrame) -> DataFrame:
    """Counts of all neighbouring frames' bins, in one matrix."""
    rows = bins.withColumn("to", F.lead("bin").over(W.partitionBy("clip_id").orderBy("pos"))).where(F.col("to").isNotNull())
    return rows.groupBy(*KEYS, F.lit("any").alias("dir"), F.col("bin").alias("frm"), "to").agg(F.count(F.lit(1)).alias("cnt"))


def dyads(steps: DataFrame) -> DataFrame:
    """``clip_id, raga, dir, frm, to, cnt``: sparse transition counts."""
    return steps.groupBy(*KEYS, "dir", "frm", "to").agg(F.count(F.lit(1)).alias("cnt"))


def dyad_totals(bins: DataFrame, counts: DataFrame, p: Params = Params()) -> DataFrame:
    """``clip_id, raga, dir, s, z``: total and normaliser of each matrix.

    Clips with too few binned frames have all-zero matrices without smoothing; they
    are absent here.
    """
    ways = F.explode(F.array(F.lit("up"), F.lit("down"))).alias("dir")
    enough = bins.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= p.min_stable).select(*KEYS, ways)
    sums = counts.groupBy("clip_id", "dir").agg(F.sum("cnt").alias("s"))
    s = F.coalesce("s", F.lit(0)).cast("double")
    return enough.join(sums, ["clip_id", "dir"], "left").select(*KEYS, "dir", s.alias("s"), (s + p.alpha * p.n_bins**2 + p.eps).alias("z"))


def coverage(all_runs: DataFrame, p: Params = Params()) -> DataFrame:
    """``clip_id, coverage``: share of the binned frames that lie in stable runs."""
    return all_runs.groupBy("clip_id").agg((F.sum(F.when(F.col("len") >= p.min_stable, F.col("len")).otherwise(0)) / F.sum("len")).alias("coverage"))


def scale_fit(stable_runs: DataFrame, scales: DataFrame, p: Params = Params()) -> DataFrame:
    """How well stable bins keep to their class's scale (``raga, semitone`` rows).

    ``prec_raw`` is the share of runs in the scale, ``prec_corrected`` the same beyond
    chance, ``recall`` the share of the scale met, ``residual`` the mean distance from
    the semitone grid. Classes without a scale are left out.
    """
    sizes = scales.groupBy("raga").agg(F.count(F.lit(1)).alias("k"))
    rows = stable_runs.select(*KEYS, pitch.semitone(F.col("bin"), p.n_bins).alias("semitone"), pitch.grid_residual(F.col("bin"), p.n_bins).alias("res"))
    known = scales.select("raga", "semitone", F.lit(1).alias("hit"))
    met = rows.join(F.broadcast(sizes), "raga").join(F.broadcast(known), ["raga", "semitone"], "left")
    out = met.groupBy(*KEYS, "k").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("prec_raw"), (F.count_distinct(F.when(F.col("hit") == 1, F.col("semitone"))) / F.first("k")).alias("recall"), F.avg("res").alias("residual"))
    chance = F.col("k") / 12.0
    corrected = F.when(chance < 1, (F.col("prec_raw") - chance) / (1 - chance)).otherwise(0.0)
    return out.select(*KEYS, "prec_raw", corrected.alias("prec_corrected"), "recall", "residual")


def collapsed(symbols: DataFrame) -> DataFrame:
    """``clip_id, pos, symbol`` without repeats of the symbol before, numbered anew."""
    clip = W.partitionBy("clip_id").orderBy("pos")
    changed = symbols.withColumn("b", F.lag("symbol").over(clip)).where(F.col("b").isNull() | (F.col("b") != F.col("symbol")))
    return changed.select("clip_id", (F.row_number().over(clip) - 1).cast("long").alias("pos"), "symbol")


def ngram_counts(symbols: DataFrame, ngram) -> DataFrame:
    """``clip_id, n``: overlapping occurrences of a sequence of symbols, 0 included."""
    clip = W.partitionBy("clip_id").orderBy("pos")
    hit = F.lit(True)
    for k, s in enumerate(ngram):
        hit = hit & F.coalesce((F.lead("symbol", k).over(clip) if k else F.col("symbol")) == F.lit(s), F.lit(False))
    return symbols.select("clip_id", hit.cast("long").alias("hit")).groupBy("clip_id").agg(F.sum("hit").alias("n"))


def ngram_recall(target: DataFrame, confuser: DataFrame) -> DataFrame:
    """Recall of an n-gram in two groups of :func:`ngram_counts`, and their ratio (infinite if the second has none)."""
    a = target.agg(F.avg((F.col("n") > 0).cast("double")).alias("target_recall"), F.avg("n").alias("target_mean"))
    b = confuser.agg(F.avg((F.col("n") > 0).cast("double")).alias("confuser_recall"))
    ratio = F.when(F.col("confuser_recall") > 0, F.col("target_recall") / F.col("confuser_recall")).otherwise(F.lit(float("inf")))
    return a.crossJoin(b).withColumn("discrimination", ratio)  # one row each
