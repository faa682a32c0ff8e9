"""Estimation of the tonic of each clip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchloom.functions import pitch
from pitchloom.params import Params


def pitch_histogram(frames: DataFrame, n: int) -> DataFrame:
    """``clip_id, lo, hi, b, cnt``: ``n`` bins from the lowest to the highest pitch of a clip.

    A clip of one pitch gets a range of half a hertz on both sides. The range comes
    from a window, so that the frames are shuffled once.
    """
    clip = W.partitionBy("clip_id")
    rows = frames.where(F.col("f0").isNotNull()).select("clip_id", "f0", F.min("f0").over(clip).alias("a"), F.max("f0").over(clip).alias("z"))
    half = F.when(F.col("a") == F.col("z"), 0.5).otherwise(0.0)
    rows = rows.select("clip_id", "f0", (F.col("a") - half).alias("lo"), (F.col("z") + half).alias("hi"))
    b = F.least(F.floor((F.col("f0") - F.col("lo")) * n / (F.col("hi") - F.col("lo"))), F.lit(n - 1)).cast("int")
    return rows.withColumn("b", b).groupBy("clip_id", "lo", "hi", "b").agg(F.count(F.lit(1)).alias("cnt"))


def peaks(histogram: DataFrame, p: Params) -> DataFrame:
    """The fullest bins with their centres; ties go to the higher bin."""
    order = W.partitionBy("clip_id").orderBy(F.desc("cnt"), F.desc("b"))
    ranked = histogram.withColumn("peak", F.row_number().over(order)).where(F.col("peak") <= p.tonic_peaks)
    return ranked.select("clip_id", "peak", pitch.bin_centre(F.col("b"), F.col("lo"), F.col("hi"), p.tonic_bins).alias("hz"))


def tonic(frames: DataFrame, p: Params = Params()) -> DataFrame:
    """``clip_id, sa, score``: the octave transposition of a peak that most frames are near to.

    Clips with fewer than ``min_voiced`` voiced frames are left out. Ties go to the
    less full peak, then to the lower octave.
    """
    voiced = frames.where(F.col("f0").isNotNull()).select("clip_id", "f0")
    long_enough = voiced.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= p.min_voiced)
    found = peaks(pitch_histogram(voiced, p.tonic_bins), p).join(long_enough.select("clip_id"), "clip_id", "left_semi")
    options = found.select("clip_id", "peak", F.explode(pitch.octave_candidates(F.col("hz"), p.tonic_multipliers, p.tonic_low, p.tonic_high)).alias("c")).select("clip_id", "peak", "c.*")
    # At most peaks x multipliers options per clip: they are sent to the frames as one array.
    arrays = options.groupBy("clip_id").agg(F.collect_list(F.struct("peak", "m", "hz")).alias("options"))
    # A frame is compared with all options in its own row; one sum for each place of the array.
    near = lambda k: (F.abs(pitch.cents(F.col("f0"), F.get(F.col("options"), F.lit(k))["hz"])) < p.tonic_tolerance).cast("long")
    sums = F.array(*[F.sum(near(k)) for k in range(p.tonic_peaks * len(p.tonic_multipliers))])
    tried = voiced.join(arrays, "clip_id").groupBy("clip_id").agg(F.first("options").alias("options"), sums.alias("score"))
    scored = tried.select("clip_id", F.explode(F.arrays_zip("options", "score")).alias("x")).where("x.options is not null").select("clip_id", "x.options.*", "x.score")
    order = W.partitionBy("clip_id").orderBy(F.desc("score"), F.desc("peak"), "m")
    return scored.withColumn("r", F.row_number().over(order)).where("r = 1").select("clip_id", F.col("hz").alias("sa"), "score")


def status(frames: DataFrame, p: Params = Params()) -> DataFrame:
    """``clip_id, status, voiced``: why :func:`tonic` leaves a clip out (``NO VOICED FRAMES``, ``TOO FEW FRAMES``), or ``OK``."""
    voiced = frames.groupBy("clip_id").agg(F.count("f0").alias("voiced"))
    return voiced.select("clip_id", F.when(F.col("voiced") == 0, "NO VOICED FRAMES").when(F.col("voiced") < p.min_voiced, "TOO FEW FRAMES").otherwise("OK").alias("status"), "voiced")


def require_enough(frames: DataFrame, p: Params = Params(), shown: int = 5) -> DataFrame:
    """``frames``, or an error that names some clips with too few voiced frames, before anything is estimated."""
    short = [r["clip_id"] for r in status(frames, p).where("status <> 'OK'").orderBy("clip_id").limit(shown).collect()]
    if short:
        raise ValueError(f"too few voiced frames in clips such as {short}")
    return frames


def median_tonic(frames: DataFrame) -> DataFrame:
    """Variant: the median pitch."""
    return frames.where(F.col("f0").isNotNull()).groupBy("clip_id").agg(F.median("f0").alias("sa"))


def peak_tonic(frames: DataFrame, p: Params = Params()) -> DataFrame:
    """Variant: the centre of the fullest bin; here ties go to the lower bin."""
    order = W.partitionBy("clip_id").orderBy(F.desc("cnt"), "b")
    found = pitch_histogram(frames, p.tonic_bins).withColumn("r", F.row_number().over(order)).where("r = 1")
    return found.select("clip_id", pitch.bin_centre(F.col("b"), F.col("lo"), F.col("hi"), p.tonic_bins).alias("sa"))


def validated(frames: DataFrame, tonics: DataFrame, tolerance: float = 50.0) -> DataFrame:
    """Variant: how good a tonic is, as 0.7 of the share of near frames and 0.3 of that of near neighbours."""
    order = W.partitionBy("clip_id").orderBy("frame_idx")
    c = pitch.fold(pitch.cents(F.col("f0"), F.col("sa")))
    near = frames.where(F.col("f0").isNotNull()).join(tonics.select("clip_id", "sa"), "clip_id").select("clip_id", "frame_idx", (F.least(c, 1200 - c) < tolerance).cast("double").alias("near"))
    both = near.withColumn("both", F.col("near") * F.lead("near").over(order))
    return both.groupBy("clip_id").agg(F.avg("near").alias("density"), F.coalesce(F.avg("both"), F.lit(0.0)).alias("continuity")).withColumn("score", 0.7 * F.col("density") + 0.3 * F.col("continuity"))


def folded(frames: DataFrame, tonics: DataFrame | None = None, sa: float | None = None) -> DataFrame:
    """``frames`` with ``cents`` in one octave above the clip's tonic, or above a fixed one; null if unvoiced."""
    rows = frames.withColumn("sa", F.lit(float(sa))) if tonics is None else frames.join(tonics.select("clip_id", "sa"), "clip_id")
    return rows.withColumn("cents", pitch.fold(pitch.cents(F.col("f0"), F.col("sa"))))
