"""Segments of clips against whole clips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchloom.operators import features, gate, segments, tonic
from pitchloom.params import Params

P = Params().but(n_bins=12, min_stable=2)


@pytest.fixture(scope="module")
def folded(spark):
    rnd, rows = random.Random(4), []
    for clip, n in ((1, 700), (2, 11), (3, 10), (4, 1), (5, 400)):
        pitch, i = 150.0, 0
        while i < n:
            hold = rnd.choice([1, 1, 2, 3, 12, 60, 130])
            pitch = rnd.choice([100.0, 112.0, 150.0, 151.0, None])
            for _ in range(min(hold, n - i)):
                rows.append((clip, clip % 2, i, pitch, pitch is not None and rnd.random() < 0.95))
                i += 1
    rows += [(6, 0, i, None, False) for i in range(40)] + [(6, 0, i, 120.0, True) for i in range(40, 90)]
    frames = spark.createDataFrame(rows, "clip_id long, raga int, frame_idx long, f0 double, voiced boolean")
    return tonic.folded(frames, sa=100.0).cache()


def rows(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("size", [10, 13, 50, 1000])
def test_segments_equal_whole_clips(folded, size):
    columns = [*folded.columns, "kept"]
    assert rows(segments.gate(folded, P, size), columns) == rows(gate.gate(folded, P), columns)
    own = features.runs(features.binned(folded, P))
    columns = ["clip_id", "raga", "run", "bin", "len", "first"]
    assert rows(segments.runs(folded, P, size), columns) == rows(own, columns)
    for variant in ("stable", "into", "out_of"):
        columns = ["clip_id", "raga", "dir", "frm", "to"]
        assert rows(segments.transitions(segments.runs(folded, P, size), P, variant, 3), columns) == rows(features.transitions(own, P, variant), columns)


def test_a_segment_has_a_window(folded):
    with pytest.raises(ValueError, match="window"):
        segments.gate(folded, P, 9)


def test_a_clip_of_ten_million_frames(spark):
    n = 10_000_000
    i = F.col("id")
    bin_ = F.pmod(F.floor(i / 7) * 5, F.lit(12))
    clip = spark.range(0, n, 1, 8).select(F.lit(1).alias("clip_id"), F.lit(1).alias("raga"), i.alias("frame_idx"), F.when(i % 1000 < 990, bin_ * 100 + 50.0).alias("cents"), (i % 1000 < 990).alias("voiced"))
    x = np.arange(n)
    bins = (x // 7 * 5 % 12)[x % 1000 < 990]
    got = segments.runs(clip, P).agg(F.count("*"), F.sum("len"), F.max("run"), F.max("first")).first()
    change = np.flatnonzero(bins[1:] != bins[:-1]) + 1
    assert tuple(got) == (len(change) + 1, len(bins), len(change) + 1, change[-1])
    sizes = segments.gate(clip, P).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()
    assert sum(r["n"] for r in sizes) == n and max(r["n"] for r in sizes) < n
