"""Clips whose frames arrive in pieces: partial counts in keyed state until a clip is whole.

The state of a clip is its histogram's counts and the number of its frames so far: of
fixed size, however long the clip is. Clips are dealt into buckets by a hash, and a
bucket's open clips are one state, so that Python is called for a bucket and not for every
clip. A clip is given out when as many frames have come as its rows announce
(``n_frames``), or, with what there is, when none has come for some time. State and output
are checkpointed together, so that a restart goes on where it was, and no piece counts
twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pitchloom.functions import pitch
from pitchloom.params import Params
from pitchloom.shipping import known_to_workers

#: A row of 64-bit integers for each open clip of a bucket: the columns below, then a count for each bin.
STATE = "clips binary"
CLIP, RAGA, TOTAL, LAST, SEEN, COUNTS = range(6)
WHOLE = "clip_id long, raga int, counts array<long>, seen long, whole boolean"
#: Buckets of clips. A checkpoint holds for one number of them.
BUCKETS = 1024
#: Stands for null in these integers.
NONE = -(1 << 63)


def _merged(rows):
    """Rows of clips, later ones last, as one row a clip: frames and counts are summed, the latest class counts."""
    import numpy as np

    clips, at = np.unique(rows[:, CLIP], return_inverse=True)
    out = np.full((len(clips), rows.shape[1]), NONE, np.int64)
    out[:, SEEN:] = 0
    np.add.at(out[:, SEEN:], at, rows[:, SEEN:])
    np.maximum.at(out[:, TOTAL : LAST + 1], at, rows[:, TOTAL : LAST + 1])
    out[:, CLIP] = clips
    last = len(rows) - 1 - np.unique(rows[::-1, CLIP], return_index=True)[1]
    out[:, RAGA] = rows[last, RAGA]
    return out


def _counted(piece, n_bins: int, now: int):
    """A row a clip of some frames; ``bin`` is ``n_bins`` where a frame is unvoiced."""
    import numpy as np

    clip, raga, total, bins = (piece[c].to_numpy(np.int64) for c in ("clip_id", "raga", "n_frames", "bin"))
    if len(bins) and not 0 <= bins.min() <= bins.max() <= n_bins:
        raise ValueError("a frame lies outside the octave")
    clips, first, at = np.unique(clip, return_index=True, return_inverse=True)
    out = np.empty((len(clips), COUNTS + n_bins), np.int64)
    out[:, CLIP], out[:, RAGA], out[:, TOTAL], out[:, LAST] = clips, raga[first], NONE, now
    np.maximum.at(out[:, TOTAL], at, total)
    if (out[:, TOTAL] == NONE).any():
        raise ValueError("frames must announce how many their clip has")
    out[:, SEEN] = np.bincount(at, minlength=len(clips))
    out[:, COUNTS:] = np.bincount(at * (n_bins + 1) + bins, minlength=len(clips) * (n_bins + 1)).reshape(len(clips), n_bins + 1)[:, :n_bins]
    return out


def _update(n_bins: int, wait_ms: int | None):
    def update(key: tuple, pieces: Iterator, state: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        open_ = np.frombuffer(state.get[0], np.int64).reshape(-1, COUNTS + n_bins) if state.exists else np.empty((0, COUNTS + n_bins), np.int64)
        now = 0 if wait_ms is None else state.getCurrentProcessingTimeMs()
        if not state.hasTimedOut:
            for piece in pieces:
                open_ = _merged(np.concatenate([open_, _counted(piece, n_bins, now)]))
        whole = open_[:, SEEN] >= open_[:, TOTAL]
        done = whole if wait_ms is None else whole | (open_[:, LAST] + wait_ms <= now)
        rest = open_[~done]
        if len(rest):
            state.update((rest.tobytes(),))
            if wait_ms is not None:
                state.setTimeoutDuration(max(1, int(rest[:, LAST].min()) + wait_ms - now))
        else:
            state.remove()
        if done.any():
            out = open_[done]
            known = lambda k: pd.Series(out[:, k]).astype("Int64").where(out[:, k] != NONE)
            yield pd.DataFrame({"clip_id": known(CLIP), "raga": known(RAGA).astype("Int32"), "counts": list(out[:, COUNTS:]), "seen": out[:, SEEN], "whole": whole[done]})

    return update


def whole_clips(frames: DataFrame, p: Params = Params(), wait_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``clip_id, raga, counts, seen, whole`` of a stream of ``clip_id, raga, cents, n_frames`` rows, a clip when it is whole.

    ``counts`` has a count for each bin; unvoiced frames (null ``cents``) only count as
    seen. With ``wait_ms``, a clip without news for so long is given out as it is. Frames
    that come after that begin the clip anew. A bucket's state is read and written as a
    whole: with very many open clips, take more ``buckets``.
    """
    known_to_workers(frames.sparkSession)
    none = F.lit(NONE).cast("long")
    number = lambda c: F.coalesce(F.col(c).cast("long"), none).alias(c)
    bin_ = F.when(F.col("cents").isNotNull(), pitch.histogram_bin(F.col("cents"), p.n_bins)).otherwise(p.n_bins)
    rows = frames.select(F.pmod(F.xxhash64("clip_id"), F.lit(buckets)).alias("bucket"), number("clip_id"), number("raga"), number("n_frames"), bin_.cast("long").alias("bin"))
    timeout = GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("bucket").applyInPandasWithState(_update(p.n_bins, wait_ms), WHOLE, STATE, "append", timeout)


def histogram(whole: DataFrame) -> DataFrame:
    """``clip_id, raga, bin, p`` of :func:`whole_clips` rows, as ``features.histogram`` has them; clips without voiced frames have none."""
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda t, c: t + c)
    each = whole.withColumn("total", total).select("clip_id", "raga", "total", F.posexplode("counts").alias("bin", "c"))
    return each.where("c > 0").select("clip_id", "raga", "bin", (F.col("c") / F.col("total")).alias("p"))


def follow(spark: SparkSession, source: str, schema: str, decide: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, p: Params = Params(), wait_ms: int | None = None, files_per_batch: int = 1000, buckets: int = BUCKETS):
    """Start a query that reads pieces of clips and appends the decisions of those that became whole.

    ``decide`` gets :func:`whole_clips` rows. A batch's results go to a folder named by the
    batch, which is overwritten if the batch is run again after a failure. Without
    ``wait_ms`` the query ends when all that is there has been read; with it, it goes on
    until it is stopped, as only a running query can tell that a clip stays away.
    """

    def write(batch: DataFrame, number: int) -> None:
        decide(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    out = whole_clips(frames, p, wait_ms, buckets).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if wait_ms is None else out.trigger(processingTime=f"{wait_ms} milliseconds")).start()
