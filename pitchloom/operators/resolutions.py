"""Several resolutions of the octave from one pass over the frames.

Frames become runs of equal bins at ``FINE`` bins, of which every usual number of bins is
a divisor. What a coarser resolution needs follows from these runs: its histogram by
summing lengths, its runs by merging neighbours. From there on the number of bins is one
more key, ``n_bins``, of histograms, transitions, models, weights and scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchloom.functions import pitch
from pitchloom.operators import models as M
from pitchloom.params import Params
from pitchloom.sources import sinks

#: The least common multiple of 36, 48, 60, 72, 96 and 120.
FINE = 1440
KEYS = ("clip_id", "raga")
#: Means of matrix cells (classes times cells) that are broadcast.
HELD = 1 << 19


def fine_runs(folded: DataFrame) -> DataFrame:
    """``clip_id, raga, run, fine, len``: runs of voiced frames in one fine bin, numbered in order.

    A frame at exactly 1200 cents has the bin ``FINE``: histograms count it in their last
    bin, transitions leave it out.
    """
    clip = W.partitionBy("clip_id").orderBy("frame_idx")
    rows = folded.where(F.col("cents").isNotNull()).select(*KEYS, "frame_idx", F.floor(F.col("cents") * FINE / pitch.OCTAVE).cast("int").alias("fine"))
    turn = F.coalesce(F.lag("fine").over(clip) != F.col("fine"), F.lit(True)).cast("long")
    numbered = rows.withColumn("turn", turn).withColumn("run", F.sum("turn").over(clip))
    return numbered.groupBy(*KEYS, "run").agg(F.first("fine").alias("fine"), F.count(F.lit(1)).alias("len"))


def _checked(bins: Sequence[int]) -> Sequence[int]:
    if not bins or any(FINE % n for n in bins):
        raise ValueError(f"every number of bins must divide {FINE}")
    return bins


def _coarse(fine: Column, n: int) -> Column:
    return F.floor(fine / (FINE // n)).cast("int")


def histograms(fine: DataFrame, bins: Sequence[int], eps: float = 0.0) -> DataFrame:
    """``n_bins, clip_id, raga, bin, p``: the fine histogram, rolled up to every resolution.

    What is dealt by clip is the fine histogram, of at most ``FINE + 1`` rows a clip.
    """
    counts = fine.groupBy(*KEYS, "fine").agg(F.sum("len").alias("c")).repartition("clip_id")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n_bins"), F.least(_coarse(F.col("fine"), n), F.lit(n - 1)).alias("bin")) for n in _checked(bins)])).alias("x")
    rows = counts.select(*KEYS, "c", each).groupBy("x.n_bins", *KEYS, "x.bin").agg(F.sum("c").alias("c"))
    return rows.select("n_bins", *KEYS, "bin", (F.col("c") / (F.sum("c").over(W.partitionBy("clip_id", "n_bins")) + eps)).alias("p"))


def runs(fine: DataFrame, bins: Sequence[int]) -> DataFrame:
    """``n_bins, clip_id, raga, run, bin, len``: runs at every resolution, by one sort of the clip."""
    clip = W.partitionBy("clip_id").orderBy("run")
    rows = fine.where(F.col("fine") < FINE).withColumn("before", F.lag("fine").over(clip))
    own = []
    for n in _checked(bins):
        turn = F.coalesce(_coarse(F.col("before"), n) != _coarse(F.col("fine"), n), F.lit(True)).cast("long")
        own.append(F.struct(F.lit(n).alias("n_bins"), F.sum(turn).over(clip).alias("run"), _coarse(F.col("fine"), n).alias("bin")))
    rows = rows.select(*KEYS, "len", F.array(*own).alias("own")).select(*KEYS, "len", F.explode("own").alias("x"))
    return rows.groupBy("x.n_bins", *KEYS, "x.run").agg(F.first("x.bin").alias("bin"), F.sum("len").alias("len"))


def dyads(all_runs: DataFrame, p: Params = Params()) -> DataFrame:
    """``n_bins, clip_id, raga, dir, frm, to, cnt``: transitions between consecutive stable runs."""
    clip = W.partitionBy("clip_id", "n_bins").orderBy("run")
    steps = all_runs.where(F.col("len") >= p.min_stable).withColumn("to", F.lead("bin").over(clip))
    way = F.when(F.col("to") > F.col("bin"), "up").when(F.col("to") < F.col("bin"), "down")
    steps = steps.select("n_bins", *KEYS, way.alias("dir"), F.col("bin").alias("frm"), "to").where(F.col("dir").isNotNull())
    return steps.groupBy("n_bins", *KEYS, "dir", "frm", "to").agg(F.count(F.lit(1)).alias("cnt"))


def models(pcd: DataFrame, bins: Sequence[int], p: Params = Params(), clips: DataFrame | None = None) -> DataFrame:
    """``n_bins, raga, bin, mean`` of the classes with enough clips, dense over each resolution's bins.

    ``clips`` may have the classes' ``raga, clip_count`` if they are known.
    """
    counts = M.eligible(M.clip_counts(pcd) if clips is None else clips, p)
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("n_bins"), F.sequence(F.lit(0), F.lit(n - 1)).alias("bins")) for n in _checked(bins)])).alias("x")
    dense = counts.select("raga", "clip_count", grid).select("raga", "clip_count", "x.n_bins", F.explode("x.bins").alias("bin"))
    sums = pcd.groupBy("n_bins", "raga", "bin").agg(F.sum("p").alias("s"))
    return dense.join(F.broadcast(sums), ["n_bins", "raga", "bin"], "left").select("n_bins", "raga", "bin", F.coalesce(F.col("s") / F.col("clip_count"), F.lit(0.0)).alias("mean"))


def weights(model: DataFrame, p: Params = Params()) -> DataFrame:
    """``n_bins, bin, weight``: inverse class frequency over deviation, scaled to sum ``n_bins``."""
    by = model.groupBy("n_bins", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("mean") > 1 / F.col("n_bins")).cast("int")).alias("df"), F.stddev_pop("mean").alias("sd"))
    raw = (F.ln(F.col("n") / (F.col("df") + 1)) + 1) / (F.col("sd") + p.eps)
    by = by.select("n_bins", "bin", raw.alias("w"))
    return by.select("n_bins", "bin", (F.col("w") / (F.sum("w").over(W.partitionBy("n_bins")) + p.eps) * F.col("n_bins")).alias("weight"))


def _pcd_terms(pcd: DataFrame, model: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Rows ``n_bins, clip_id, raga, model, xy, sx``, to be summed, and the few sums ``n_bins, model, sy``."""
    m = model.join(F.broadcast(weights(model, p)), ["n_bins", "bin"]).select("n_bins", "bin", F.col("raga").alias("model"), "weight", (F.col("mean") * F.col("weight")).alias("y"))
    x = F.col("p") * F.col("weight")
    terms = pcd.join(F.broadcast(m), ["n_bins", "bin"]).select("n_bins", *KEYS, "model", (x * F.col("y")).alias("xy"), x.alias("sx"))
    return terms, m.groupBy("n_bins", "model").agg(F.sum("y").alias("sy"))


def _with_totals(all_runs: DataFrame, p: Params) -> DataFrame:
    """``n_bins, clip_id, raga, dir, frm, to, cnt, s, z``: :func:`dyads` with their clip's total and normaliser.

    A clip with enough frames has one more row for each direction, with ``frm`` null and
    ``cnt`` 0, so that one without transitions has its totals as well.
    """
    ways = F.explode(F.array(F.lit("up"), F.lit("down"))).alias("dir")
    none = F.lit(None).cast("int")
    enough = all_runs.groupBy("n_bins", *KEYS).agg(F.sum("len").alias("frames")).where(F.col("frames") >= p.min_stable)
    rows = dyads(all_runs, p).unionByName(enough.select("n_bins", *KEYS, ways, none.alias("frm"), none.alias("to"), F.lit(0).cast("long").alias("cnt")))
    rows = rows.withColumn("s", F.sum("cnt").over(W.partitionBy("clip_id", "n_bins", "dir")).cast("double"))
    return rows.withColumn("z", F.col("s") + p.alpha * F.col("n_bins") * F.col("n_bins") + p.eps)


def _dyad_terms(rows: DataFrame, clips: DataFrame, p: Params) -> DataFrame:
    """``n_bins, clip_id, raga, model, dy`` from stored :func:`_with_totals` rows, to be summed: products with the smoothed means.

    The dot product of a direction (see ``scoring.dyad_similarity``) is a sum over the
    clip's cells and one term for the smoothing, so that no clip meets another table of
    clips. Cells have the means of all classes in one row; up to ``HELD`` means are
    broadcast, more are joined by a shuffle.
    """
    n = F.broadcast(M.eligible(clips, p))
    met = rows.where(F.col("frm").isNotNull())
    means = met.groupBy("n_bins", "raga", "dir", "frm", "to").agg(F.sum(F.col("cnt") / F.col("z")).alias("m")).join(n, "raga")
    cells = means.groupBy("n_bins", "dir", "frm", "to").agg(F.collect_list(F.struct(F.col("raga").alias("model"), (F.col("m") / F.col("clip_count")).alias("m"))).alias("ms"))
    cells = sinks.stored(cells, "cells")
    held = cells.agg(F.coalesce(F.sum(F.size("ms")), F.lit(0))).first()[0]
    cells = F.broadcast(cells) if held <= HELD else cells.hint("merge")
    of_cells = met.join(cells, ["n_bins", "dir", "frm", "to"]).select("n_bins", *KEYS, (F.col("cnt") / F.col("z")).alias("c"), F.explode("ms").alias("x"))
    of_cells = of_cells.select("n_bins", *KEYS, "x.model", (0.5 * F.col("c") * F.col("x.m")).alias("dy"))
    each = rows.where(F.col("frm").isNull())
    sums = each.groupBy("n_bins", "raga", "dir").agg(F.sum(1 / F.col("z")).alias("u"), F.sum(F.col("s") / F.col("z")).alias("v")).join(n, "raga")
    scalars = sums.select("n_bins", F.col("raga").alias("model"), "dir", (F.col("u") / F.col("clip_count")).alias("u"), (F.col("v") / F.col("clip_count")).alias("v"))
    u, v, n2 = F.col("u"), F.col("v"), F.col("n_bins") * F.col("n_bins")
    smooth = (p.alpha * u * F.col("s") + p.alpha * v + p.alpha**2 * n2 * u) / F.col("z")
    return of_cells.unionByName(each.join(F.broadcast(scalars), ["n_bins", "dir"]).select("n_bins", *KEYS, "model", (0.5 * smooth).alias("dy")))


def scores(fine: DataFrame, bins: Sequence[int], p: Params = Params()) -> DataFrame:
    """``n_bins, clip_id, raga, model, pcd_sim, dyad_sim, score`` at every resolution.

    ``fine`` (see :func:`fine_runs`) is read for histograms and for runs: store it first.
    ``p.n_bins`` is not used. A clip without transitions has dyad similarity 0. Both
    similarities are sums of rows by clip and class, made in one aggregation; only tables
    of classes are joined and broadcast.
    """
    clips = M.clip_counts(fine)
    pcd = histograms(fine, bins)
    terms, sides = _pcd_terms(pcd, models(pcd, bins, p, clips), p)
    dyad = _dyad_terms(sinks.stored(_with_totals(runs(fine, bins), p), "dyads"), clips, p)
    none = F.lit(None).cast("double")
    rows = terms.withColumn("dy", none).unionByName(dyad.withColumn("xy", none).withColumn("sx", none))
    sums = rows.groupBy("n_bins", *KEYS, "model").agg(F.sum("xy").alias("xy"), F.sum("sx").alias("sx"), F.coalesce(F.sum("dy"), F.lit(0.0)).alias("dyad_sim")).where(F.col("sx").isNotNull())
    sim = F.col("xy") / ((F.col("sx") + p.eps) * (F.col("sy") + p.eps))
    rows = sums.join(F.broadcast(sides), ["n_bins", "model"]).select("n_bins", *KEYS, "model", sim.alias("pcd_sim"), "dyad_sim")
    return rows.select("*", (p.pcd_weight * F.col("pcd_sim") + p.dyad_weight * F.col("dyad_sim")).alias("score"))
