"""Clips in pieces, state across restarts, and computing only what a cache lacks."""

import time

from pyspark.sql import functions as F

from pitchloom.params import Params
from pitchloom.sources import listing
from pitchloom.streaming import pieces

P = Params().but(n_bins=4)
SCHEMA = "clip_id long, raga int, cents double, n_frames long"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp, **more):
    pieces.follow(spark, f"{tmp}/in", SCHEMA, lambda df: df, f"{tmp}/out", f"{tmp}/cp", P, **more).awaitTermination()
    found = spark.read.schema(pieces.WHOLE).parquet(f"{tmp}/out").collect()
    return sorted((r["clip_id"], r["counts"], r["seen"], r["whole"]) for r in found)


def test_a_clip_is_given_out_once_when_it_is_whole(spark, tmp_path):
    write(spark, f"{tmp_path}/in", [(1, 0, 10.0, 4), (2, 1, 1200.0, 1), (1, 0, None, 4)])
    assert run(spark, tmp_path) == [(2, [0, 0, 0, 1], 1, True)]
    write(spark, f"{tmp_path}/in", [(1, 0, 310.0, 4)])
    assert len(run(spark, tmp_path)) == 1  # started anew from the checkpoint: two pieces are remembered
    write(spark, f"{tmp_path}/in", [(1, 0, 320.0, 4)])
    assert run(spark, tmp_path) == [(1, [1, 2, 0, 0], 4, True), (2, [0, 0, 0, 1], 1, True)]
    assert run(spark, tmp_path) == [(1, [1, 2, 0, 0], 4, True), (2, [0, 0, 0, 1], 1, True)]


def test_a_clip_that_stays_away_is_given_out_as_it_is(spark, tmp_path):
    write(spark, f"{tmp_path}/in", [(1, 0, 10.0, 9), (3, 0, 10.0, 1)])
    running = pieces.follow(spark, f"{tmp_path}/in", SCHEMA, lambda df: df, f"{tmp_path}/out", f"{tmp_path}/cp", P, wait_ms=500)
    try:
        found, until = [], time.time() + 90
        while len(found) < 2 and time.time() < until and running.isActive:
            time.sleep(1)
            if (tmp_path / "out").is_dir():
                found = spark.read.schema(pieces.WHOLE).parquet(f"{tmp_path}/out").collect()
    finally:
        running.stop()
    assert sorted((r["clip_id"], r["counts"], r["seen"], r["whole"]) for r in found) == [(1, [1, 0, 0, 0], 1, False), (3, [1, 0, 0, 0], 1, True)]


def test_python_is_called_by_bucket_not_by_clip(spark, tmp_path):
    """Clips that share a bucket stay apart, also over restarts; a call takes all of a bucket's clips."""
    met = spark.sparkContext.accumulator(0)
    update = pieces._update

    def counting(*a):
        inner = update(*a)

        def call(key, rows, state):
            met.add(1)
            yield from inner(key, rows, state)

        return call

    pieces._update = counting
    try:
        clips = range(400)
        write(spark, f"{tmp_path}/in", [(c, c % 3, 10.0 + 300 * (c % 4), 2 + c % 2) for c in clips])
        assert run(spark, tmp_path, buckets=3) == []
        write(spark, f"{tmp_path}/in", [(c, c % 3, None if c % 5 else 1200.0, 2 + c % 2) for c in clips])
        found = run(spark, tmp_path, buckets=3)
    finally:
        pieces._update = update
    want = lambda c: [int(b == c % 4) + int(b == 3 and c % 5 == 0) for b in range(4)]
    assert found == [(c, want(c), 2, True) for c in clips if c % 2 == 0]
    assert 0 < met.value <= 12


def test_histogram_of_whole_clips(spark):
    whole = spark.createDataFrame([(1, 0, [1, 0, 3, 0], 5, True), (2, 0, [0, 0, 0, 0], 2, True)], pieces.WHOLE)
    assert sorted((r["clip_id"], r["bin"], r["p"]) for r in pieces.histogram(whole).collect()) == [(1, 0, 0.25), (1, 2, 0.75)]


def test_only_what_the_cache_lacks_is_computed_and_once(spark, tmp_path):
    clips = spark.createDataFrame([(k, float(k)) for k in range(20)], "clip_id long, y double")
    met = spark.sparkContext.accumulator(0)
    store = str(tmp_path / "store")

    def slow(rows):
        def work(batches):
            for b in batches:
                met.add(len(b))
                yield b[b["clip_id"] != 19].assign(f0=b["y"] * 2)[["clip_id", "f0"]]

        return rows.mapInPandas(work, "clip_id long, f0 double")

    cached = spark.createDataFrame([(k, -1.0) for k in range(12)] + [(12, None)], "clip_id long, f0 double")
    out = listing.cache_or_compute(clips, cached, slow, store=store)
    for _ in range(2):
        rows = {r["clip_id"]: (r["f0"], r["origin"]) for r in out.collect()}
    assert met.value == 8 and rows[3] == (-1.0, "cache") and rows[12] == (24.0, "live") and rows[19] == (None, "live") and len(rows) == 20
    again = listing.cache_or_compute(clips.where("clip_id < 19"), cached.unionByName(listing.computed_before(spark, store, "clip_id long, f0 double")), slow, store=store)
    assert again.where(F.col("origin") == "cache").count() == 19 and met.value == 8
    assert listing.computed_before(spark, str(tmp_path / "none"), "clip_id long, f0 double").count() == 0
