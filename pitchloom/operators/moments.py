"""Models that grow: moments of new clips beside those of old ones, merged when read.

An increment holds, by class and bin or transition, the number of clips ``n``, the mean
and the sum of squared deviations ``m2`` of what it has seen. Increments merge by the
pairwise rule for any number of parts: with the merged mean ``M``, the squares are those of
the parts plus ``n (mean - M)^2`` of each. What a part lacks is a part of zeros. So a run
reads only its own clips, in any order and any number of runs.

A smoothed cell of a clip's transition matrix is ``x + alpha u`` with ``x`` its count and
``u`` one over its normaliser. Cells keep the moments of ``x``, its co-moment with ``u``
and the increment's mean of ``u``; matrices keep the moments of ``u``. Mean and deviation of
every smoothed cell follow, and stay sparse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.operators import models as M
from pitchloom.params import Params

PARTS = ("classes", "clips", "bins", "cells", "scalars")


def increment(pcd: DataFrame, counts: DataFrame, totals: DataFrame) -> dict[str, DataFrame]:
    """Moments of some clips: their histograms, transition counts and totals (see ``features``).

    ``classes``: ``raga, n``; ``clips``: ``clip_id``; ``bins``: ``raga, bin, n, mean, m2``;
    ``cells``: ``raga, dir, frm, to, n, mean, m2, co, u``; ``scalars``: ``raga, dir, n, u, m2, v``.
    """
    classes = M.clip_counts(pcd).select("raga", F.col("clip_count").alias("n"))

    def moments(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
        sums = rows.groupBy("raga", *keys).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("seen"))
        means = sums.join(classes, "raga").select("raga", *keys, "n", "seen", (F.col("s") / F.col("n")).alias("mean"))
        off = rows.join(means.select("raga", *keys, "mean"), ["raga", *keys]).groupBy("raga", *keys).agg(F.sum((F.col(value) - F.col("mean")) ** 2).alias("q"))
        return means.join(off, ["raga", *keys]).select("raga", *keys, "n", "mean", (F.col("q") + (F.col("n") - F.col("seen")) * F.col("mean") ** 2).alias("m2"))

    matrices = totals.select("clip_id", "raga", "dir", (1 / F.col("z")).alias("u"), (F.col("s") / F.col("z")).alias("v"))
    scalars = moments(matrices, ["dir"], "u").withColumnRenamed("mean", "u").join(matrices.groupBy("raga", "dir").agg(F.sum("v").alias("sv")), ["raga", "dir"])
    scalars = scalars.select("raga", "dir", "n", "u", "m2", (F.col("sv") / F.col("n")).alias("v"))
    cells = counts.join(matrices.select("clip_id", "dir", F.col("u").alias("own")), ["clip_id", "dir"]).withColumn("x", F.col("cnt") * F.col("own"))
    keys = ["dir", "frm", "to"]
    # As deviations of u add up to 0, the mean of x plays no part in the co-moment.
    co = cells.join(scalars.select("raga", "dir", "u"), ["raga", "dir"]).groupBy("raga", *keys).agg(F.sum(F.col("x") * (F.col("own") - F.col("u"))).alias("co"), F.first("u").alias("u"))
    return {"classes": classes, "clips": pcd.select("clip_id").distinct(), "bins": moments(pcd, ["bin"], "p"), "cells": moments(cells, keys, "x").join(co, ["raga", *keys]), "scalars": scalars}


def _sizes(parts: dict[str, DataFrame], p: Params) -> DataFrame:
    """``raga, clip_count`` of the classes that have enough clips over all increments."""
    return M.eligible(parts["classes"].groupBy("raga").agg(F.sum("n").alias("clip_count")), p)


def _merged(rows: DataFrame, keys: list[str], sizes: DataFrame, mean: str = "mean") -> DataFrame:
    """``raga, *keys, clip_count, mean, m2`` of all increments; parts without a key are zeros."""
    sums = rows.groupBy("raga", *keys).agg(F.sum(F.col("n") * F.col(mean)).alias("s"), F.sum("n").alias("present"))
    whole = sums.join(sizes, "raga").select("raga", *keys, "clip_count", "present", (F.col("s") / F.col("clip_count")).alias("whole"))
    off = rows.join(whole.select("raga", *keys, "whole"), ["raga", *keys]).groupBy("raga", *keys).agg(F.sum(F.col("m2") + F.col("n") * (F.col(mean) - F.col("whole")) ** 2).alias("q"))
    return whole.join(off, ["raga", *keys]).select("raga", *keys, "clip_count", F.col("whole").alias("mean"), (F.col("q") + (F.col("clip_count") - F.col("present")) * F.col("whole") ** 2).alias("m2"))


def models(parts: dict[str, DataFrame], p: Params = Params()) -> DataFrame:
    """``raga, bin, mean, std, clip_count``, as :func:`pitchloom.operators.models.models` makes them of all clips at once."""
    sizes = _sizes(parts, p)
    found = _merged(parts["bins"], ["bin"], sizes).drop("clip_count")
    dense = M.grid(sizes, p).join(found, ["raga", "bin"], "left")
    return dense.select("raga", "bin", F.coalesce("mean", F.lit(0.0)).alias("mean"), "clip_count", F.sqrt(F.coalesce("m2", F.lit(0.0)) / F.col("clip_count")).alias("std"))


def dyad_models(parts: dict[str, DataFrame], p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Cells ``raga, dir, frm, to, m, mean, std`` and scalars ``raga, dir, u, v, std`` of all increments.

    ``m``, ``u`` and ``v`` are those of :func:`pitchloom.operators.models.dyad_models`;
    ``mean`` and ``std`` of a cell are those of the smoothed matrices. A cell that no clip
    has is ``alpha * u``, with the deviation that ``scalars`` tells.
    """
    sizes, a = _sizes(parts, p), p.alpha
    us = _merged(parts["scalars"], ["dir"], sizes, "u").withColumnsRenamed({"mean": "u", "m2": "m2u"})
    v = parts["scalars"].groupBy("raga", "dir").agg(F.sum(F.col("n") * F.col("v")).alias("sv"))
    scalars = us.join(v, ["raga", "dir"]).select("raga", "dir", "u", (F.col("sv") / F.col("clip_count")).alias("v"), (a * F.sqrt(F.col("m2u") / F.col("clip_count"))).alias("std"))
    keys = ["dir", "frm", "to"]
    cells = _merged(parts["cells"], keys, sizes)
    whole = us.select("raga", "dir", F.col("u").alias("whole_u"), "m2u")
    co = parts["cells"].join(whole, ["raga", "dir"]).groupBy("raga", *keys).agg(F.sum(F.col("co") + F.col("n") * F.col("mean") * (F.col("u") - F.col("whole_u"))).alias("co"), F.first("whole_u").alias("u"), F.first("m2u").alias("m2u"))
    m2 = F.greatest(F.lit(0.0), F.col("m2") + 2 * a * F.col("co") + a * a * F.col("m2u"))
    rows = cells.join(co, ["raga", *keys])
    return rows.select("raga", *keys, F.col("mean").alias("m"), (F.col("mean") + a * F.col("u")).alias("mean"), F.sqrt(m2 / F.col("clip_count")).alias("std")), scalars
