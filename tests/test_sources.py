"""Scans and sinks on files made here."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from pitchloom.operators import features, models, quality, tonic
from pitchloom.params import Params
from pitchloom.sources import adapters, archives, listing, sinks
from pitchloom.streaming import incremental

P = Params().but(n_bins=12, min_stable=2, min_clips=1)


def parts(spark):
    folded = tonic.folded(adapters.frames(spark.read.parquet("/root/testdata/sf0.001/events.parquet")), sa=100.0)
    bins = features.binned(folded, P)
    counts = features.dyads(features.transitions(features.runs(bins), P))
    pcd = features.histogram(folded, P)
    return pcd, *models.dyad_models(counts, features.dyad_totals(bins, counts, P), models.clip_counts(pcd), P)


def test_audio_listing(spark, tmp_path):
    for name in ("Todi/a.MP3", "Todi/b.txt", "Kalyani/c.wav", "top.wav"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = listing.audio_files(spark, str(tmp_path)).collect()
    assert sorted((r["raga"], r["file"]) for r in got) == [("Kalyani", "c.wav"), ("Todi", "a.MP3")]
    with pytest.raises(ValueError):
        listing.track(listing.audio_files(spark, str(tmp_path)), "none")


def test_models_round_trip(spark, tmp_path):
    pcd, cells, scalars = parts(spark)
    model = models.models(pcd, P)
    sinks.write_models(model, cells, scalars.where("raga <> 2"), str(tmp_path), "20250101_000000")
    back, _, _ = listing.model_store(spark, str(tmp_path), "20250101_000000")
    assert {r["raga"] for r in back.select("raga").distinct().collect()} == {r["raga"] for r in model.select("raga").distinct().collect()} - {2}
    with pytest.raises(Exception):
        sinks.write_models(model, cells, scalars, str(tmp_path), "20250101_000000")


def test_feature_store_filters(spark, tmp_path):
    rows = [("a", 0.5, [1.0] * 3), ("b", 0.01, [1.0] * 3), ("c", 0.5, [1.0])]
    clips = spark.createDataFrame([(n, "r", g, c) for n, g, c in rows], "clip_id string, raga string, gating_ratio double, cents_gated array<double>")
    sinks.write_features(clips, str(tmp_path / "f"), P)
    assert [r["clip_id"] for r in listing.feature_store(spark, str(tmp_path / "f"), P, 2).collect()] == ["a"]


def test_metadata_and_archives(spark, tmp_path):
    (tmp_path / "m/x").mkdir(parents=True)
    (tmp_path / "m/x/1.json").write_text(json.dumps({"raaga": [{"name": "Todi", "common_name": "Thodi"}], "title": "T", "album_artists": [{"name": "A"}]}))
    (tmp_path / "m/x/2.json").write_text("{not json")
    got = listing.song_metadata(spark, str(tmp_path / "m")).drop("path").collect()
    assert [tuple(r) for r in got] == [("T", "A", "Todi", "Thodi")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name, size in (("c/s/a.vocal.mp3", 2000), ("c/s/._b.mp3", 2000), ("c/s/small.mp3", 10), ("c/s/t.txt", 5000)):
            z.writestr(name, b"0" * size)
    found = listing.archive_entries(archives.listing(spark, str(tmp_path / "z.zip"))).collect()
    assert [(r["file"], r["song"], r["is_vocal"]) for r in found] == [("a.vocal.mp3", "s", True)]


def test_csv_report_and_incremental_scan(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1), ("a", 2)], "raga string, n int")
    sinks.write_csv(rows, str(tmp_path / "c"), ["raga"])
    assert [r["raga"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == ["a", "b"]
    assert sinks.report(rows).splitlines()[0].split() == ["raga", "n"]
    staged = spark.createDataFrame([("x/New song.mp3",), ("x/Old song.mp3.mp3",)], "path string")
    old = spark.createDataFrame([("old song.vocal",)], "base string")
    assert [r["path"] for r in quality.not_extracted(staged, old).collect()] == ["x/New song.mp3"]


def test_followed_files_give_each_result_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 2.0)], "clip_id long, x double").write.parquet(src)
    go = lambda: incremental.follow(spark, src, "clip_id long, x double", lambda df: df.groupBy("clip_id").agg(F.sum("x").alias("x")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    spark.createDataFrame([(2, 3.0)], "clip_id long, x double").write.mode("append").parquet(src)
    go()
    got = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert sorted((r["clip_id"], r["x"]) for r in got) == [("1", "2.0"), ("2", "3.0")]
