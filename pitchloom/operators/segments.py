"""Gate, runs and transitions of clips of any length, in segments of frames.

A segment of ``size`` frames is a task's unit instead of a clip. The gate's windows reach
over a border, so each segment also gets a window of frames of both neighbours (its halo).
Runs that touch a border are stitched: a row per segment (first and last bin, numbers of
frames and runs) tells what was before it. Only these rows, a clip's frames divided by
``size``, meet by clip. ``frame_idx`` must count a clip's frames without gaps from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchloom.functions import pitch
from pitchloom.params import Params

#: Frames of a segment: an hour and a half at the usual hop.
SIZE = 250_000
KEYS = ("clip_id", "raga")


def gate(folded: DataFrame, p: Params = Params(), size: int = SIZE) -> DataFrame:
    """``folded`` with ``kept``, as by :func:`pitchloom.operators.gate.gate`."""
    w, half = p.window, p.window // 2
    if size < w:
        raise ValueError("a segment must have a window's frames at least")
    own = F.floor(F.col("frame_idx") / size)
    inside = F.col("frame_idx") - own * size
    # The first frames also belong to the segment before, the last ones to the one behind.
    to = F.array_compact(F.array(own, F.when((inside < w) & (own > 0), own - 1), F.when(inside >= size - w, own + 1)))
    rows = folded.withColumn("g", F.coalesce("cents", F.lit(0.0))).withColumn("own", own).withColumn("seg", F.explode(to))
    part = W.partitionBy("clip_id", "seg").orderBy("frame_idx")
    ratio = F.avg(F.col("voiced").cast("double")).over(part.rowsBetween(0, w - 1))
    drift = F.abs(F.avg("g").over(part.rowsBetween(half, w - 1)) - F.avg("g").over(part.rowsBetween(0, half - 1)))
    # The last window of a clip is not tried: another frame must follow a window.
    ok = F.lead("frame_idx", w).over(part).isNotNull() & (ratio >= p.voiced_ratio) & (drift < p.drift)
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)).cast("int"))
    rows = rows.withColumn("kept", F.max("ok").over(part.rowsBetween(-(w - 1), 0)) == 1)
    return rows.where("own = seg").withColumn("cents", F.col("g")).drop("ok", "g", "own", "seg")


def runs(folded: DataFrame, p: Params = Params(), size: int = SIZE) -> DataFrame:
    """``clip_id, raga, run, bin, len, first``, as by ``features.runs(features.binned(folded))``."""
    rows = folded.select(*KEYS, "frame_idx", F.floor(F.col("frame_idx") / size).alias("seg"), pitch.digitised_bin(F.col("cents"), p.n_bins).alias("bin")).where(F.col("bin").isNotNull())
    part = W.partitionBy("clip_id", "seg").orderBy("frame_idx")
    turn = F.coalesce(F.lag("bin").over(part) != F.col("bin"), F.lit(True)).cast("long")
    numbered = rows.withColumn("turn", turn).withColumn("own", F.sum("turn").over(part)).withColumn("pos", (F.row_number().over(part) - 1).cast("long"))
    local = numbered.groupBy(*KEYS, "seg", "own").agg(F.first("bin").alias("bin"), F.count(F.lit(1)).alias("len"), F.min("pos").alias("pos"))
    told = local.groupBy("clip_id", "seg").agg(F.sum("len").alias("frames"), F.count(F.lit(1)).alias("runs"), F.min_by("bin", "own").alias("head"), F.max_by("bin", "own").alias("tail"))
    # A row for each segment that has any bin.
    clip = W.partitionBy("clip_id").orderBy("seg")
    before = clip.rowsBetween(W.unboundedPreceding, -1)
    joined = told.withColumn("joins", (F.col("head") == F.lag("tail").over(clip)).cast("long")).withColumn("joins", F.coalesce("joins", F.lit(0)))
    offsets = joined.select("clip_id", "seg", F.coalesce(F.sum("frames").over(before), F.lit(0)).alias("at"), (F.coalesce(F.sum("runs").over(before), F.lit(0)) - F.sum("joins").over(clip)).alias("upto"))
    placed = local.join(offsets, ["clip_id", "seg"]).select(*KEYS, (F.col("upto") + F.col("own")).alias("run"), "bin", "len", (F.col("at") + F.col("pos")).alias("first"))
    return placed.groupBy(*KEYS, "run").agg(F.first("bin").alias("bin"), F.sum("len").alias("len"), F.min("first").alias("first"))


def neighbour(rows: DataFrame, order: str, value: str, to: str, step: int = 1, size: int = SIZE) -> DataFrame:
    """``rows`` with ``to``: ``value`` of the clip's next row (``step`` 1) or of the one before (-1).

    ``order`` is a whole number; a segment has ``size`` of its values.
    """
    if step not in (1, -1):
        raise ValueError("step is 1 or -1")
    cut = rows.withColumn("_seg", F.floor(F.col(order) / size))
    part, clip = W.partitionBy("clip_id", "_seg").orderBy(order), W.partitionBy("clip_id").orderBy("_seg")
    move = F.lead if step == 1 else F.lag
    end = F.min_by if step == 1 else F.max_by
    inside = cut.withColumn("_in", move(F.struct(value)).over(part))
    ends = cut.groupBy("clip_id", "_seg").agg(end(F.struct(value), order).alias("_end")).select("clip_id", "_seg", move("_end").over(clip).alias("_out"))
    return inside.join(ends, ["clip_id", "_seg"]).withColumn(to, F.coalesce("_in", "_out")[value]).drop("_seg", "_in", "_out")


def transitions(all_runs: DataFrame, p: Params = Params(), variant: str = "stable", size: int = SIZE) -> DataFrame:
    """``clip_id, raga, dir, frm, to``: a row per transition, as by ``features.transitions``."""
    stable = F.col("len") >= p.min_stable
    if variant == "stable":
        steps = neighbour(all_runs.where(stable), "run", "bin", "to", 1, size).withColumnRenamed("bin", "frm")
    elif variant == "into":
        steps = neighbour(all_runs, "run", "bin", "frm", -1, size).where(stable).withColumnRenamed("bin", "to")
    elif variant == "out_of":
        steps = neighbour(all_runs, "run", "bin", "to", 1, size).where(stable & F.col("to").isNotNull())
        return steps.select(*KEYS, F.lit("any").alias("dir"), F.col("bin").alias("frm"), "to")
    else:
        raise ValueError(variant)
    way = F.when(F.col("to") > F.col("frm"), "up").when(F.col("to") < F.col("frm"), "down")
    return steps.select(*KEYS, way.alias("dir"), "frm", "to").where(F.col("dir").isNotNull())
