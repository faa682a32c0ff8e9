"""Hand-made cases with literal expectations."""

import math

import pytest
from pyspark.sql import functions as F

from pitchloom.functions import names, pitch
from pitchloom.operators import decide, evaluate, features, gate, models, quality, scoring, stats, tonic
from pitchloom.params import UNKNOWN, Params
from pitchloom.sources import adapters, listing, sinks

P = Params().but(n_bins=12, min_stable=2, min_voiced=1)


def one(spark, value, f, kind="double"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("c, folded", [(-100, 1100), (0, 0), (1200, 0), (2500, 100)])
def test_fold(spark, c, folded):
    assert one(spark, float(c), pitch.fold) == folded


@pytest.mark.parametrize("c, b", [(0, 0), (99.999, 0), (100, 1), (1199.9, 11)])
def test_bins_agree_inside(spark, c, b):
    assert one(spark, float(c), lambda x: pitch.histogram_bin(x, 12)) == b
    assert one(spark, float(c), lambda x: pitch.digitised_bin(x, 12)) == b
    assert one(spark, float(c), lambda x: pitch.clipped_bin(x, 12)) == b


def test_right_edge(spark):
    assert one(spark, 1200.0, lambda x: pitch.histogram_bin(x, 12)) == 11
    assert one(spark, 1200.0, lambda x: pitch.digitised_bin(x, 12)) is None
    assert one(spark, 1300.0, lambda x: pitch.clipped_bin(x, 12)) == 11


def test_cents_and_residual(spark):
    assert math.isclose(one(spark, 200.0, lambda x: pitch.cents(x, 100.0)), 1200)
    assert one(spark, 7, lambda x: pitch.grid_residual(x, 72), "int") == pytest.approx(1200 / 72)
    assert one(spark, 13, lambda x: pitch.semitone(x, 72), "int") == 2
    assert one(spark, float("nan"), pitch.no_nan) is None


def bins(spark, seq, clip=1, raga=1):
    return spark.createDataFrame([(clip, raga, i, b) for i, b in enumerate(seq)], "clip_id long, raga int, pos long, bin int")


def steps(spark, seq, variant="stable"):
    rows = features.transitions(features.runs(bins(spark, seq)), P, variant).collect()
    return sorted((r["dir"], r["frm"], r["to"]) for r in rows)


def test_runs_and_transitions(spark):
    assert steps(spark, [3, 3, 5, 7, 7, 7, 3, 3]) == [("down", 7, 3), ("up", 3, 7)]
    assert steps(spark, [4, 4, 9, 4, 4]) == []
    assert steps(spark, [1, 1, 2, 2]) == [("up", 1, 2)]
    assert steps(spark, [3, 3, 5, 7, 7], "into") == [("up", 5, 7)]
    assert steps(spark, [3, 3, 5, 7, 7], "out_of") == [("any", 3, 5)]


def frames(spark, values, voiced=None):
    rows = [(1, 1, i, v, v is not None if voiced is None else voiced[i]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "clip_id long, raga int, frame_idx long, f0 double, voiced boolean")


def kept(spark, values):
    out = gate.gate(tonic.folded(frames(spark, values), sa=100.0), P)
    return [r["kept"] for r in out.orderBy("frame_idx").collect()], gate.ratios(out, P).first()["gating_ratio"]


def test_gate_needs_a_window_more(spark):
    assert not any(kept(spark, [150.0] * 10)[0])
    assert kept(spark, [150.0] * 11)[0] == [True] * 10 + [False]


def test_gate_keeps_unvoiced_frames(spark):
    mask, ratio = kept(spark, [100.0] * 5 + [None, None] + [100.0] * 5)
    assert all(mask[:11]) and ratio > 1


def test_short_clips_are_told_or_refused(spark):
    rows = [(1, 1, i, 150.0, True) for i in range(20)] + [(2, 1, i, None, False) for i in range(30)] + [(3, 1, 0, 150.0, True)]
    df = spark.createDataFrame(rows, "clip_id long, raga int, frame_idx long, f0 double, voiced boolean")
    p = P.but(min_voiced=20)
    assert {r["clip_id"]: r["status"] for r in tonic.status(df, p).collect()} == {1: "OK", 2: "NO VOICED FRAMES", 3: "TOO FEW FRAMES"}
    with pytest.raises(ValueError, match=r"\[2, 3\]"):
        tonic.require_enough(df, p)
    assert tonic.require_enough(df.where("clip_id = 1"), p).count() == 20


def test_run_ids(spark):
    got = spark.range(1).select(names.run_id().alias("now"), names.run_id(F.lit("2025-03-04 05:06:07").cast("timestamp")).alias("then")).first()
    assert got["then"] == "run_20250304_050607" and len(got["now"]) == 19 and got["now"] > "run_2025"


def test_tonic_of_one_pitch(spark):
    rows = frames(spark, [220.0] * 30)
    got = tonic.tonic(rows, P).first()
    assert got["score"] == 30 and abs(1200 * math.log2(got["sa"] / 220)) < 50
    assert tonic.tonic(rows, P.but(min_voiced=31)).count() == 0
    assert tonic.median_tonic(rows).first()["sa"] == 220


def histograms(spark, rows):
    return spark.createDataFrame([(c, g, b, float(p)) for c, g, v in rows for b, p in enumerate(v) if p], "clip_id long, raga int, bin int, p double")


def test_models_count_missing_bins(spark):
    p = P.but(n_bins=2, min_clips=2)
    got = {r["bin"]: r for r in models.models(histograms(spark, [(1, 1, [1, 0]), (2, 1, [0, 1]), (3, 2, [1, 0])]), p).collect()}
    assert got[0]["mean"] == 0.5 and got[0]["std"] == 0.5 and got[0]["clip_count"] == 2 and len(got) == 2


def test_population_deviation(spark):
    p = P.but(n_bins=1, min_clips=2)
    assert models.models(histograms(spark, [(1, 1, [1]), (2, 1, [3])]), p).first()["std"] == pytest.approx(1.0)


def test_min_clips(spark):
    pcd = histograms(spark, [(i, 1, [1]) for i in range(4)] + [(i + 10, 2, [1]) for i in range(5)])
    counts = models.clip_counts(pcd)
    assert [tuple(r) for r in models.excluded(counts, Params()).collect()] == [(1, 4, 1)]
    assert [r["raga"] for r in models.eligible(counts, Params()).collect()] == [2]


def test_weights_of_equal_models(spark):
    p = P.but(n_bins=2, min_clips=1)
    w = {r["bin"]: r["weight"] for r in models.weights(models.models(histograms(spark, [(1, 1, [0.5, 0.5]), (2, 2, [0.5, 0.5])]), p), p).collect()}
    assert w[0] == pytest.approx(1.0) and w[1] == pytest.approx(1.0)


def scores(spark, rows):
    return spark.createDataFrame(rows, "clip_id long, raga int, model int, score double")


def test_tiers_and_ties(spark):
    rows = [(1, 1, 1, 0.503), (1, 1, 2, 0.5), (2, 1, 1, 0.501), (2, 1, 2, 0.5), (3, 1, 2, 0.5), (3, 1, 1, 0.5), (4, 1, 9, 0.5)]
    p = Params().but(margin_strict=0.0029999, margin_min=0.0009999)
    got = {r["clip_id"]: (r["final"], r["confidence_tier"]) for r in decide.decisions(scores(spark, rows), None, p).collect()}
    assert got[1] == ("1", "HIGH") and got[2] == ("1", "MODERATE") and got[3] == (UNKNOWN, "UNKNOWN") and got[4] == (UNKNOWN, "UNKNOWN")
    assert [r["model"] for r in decide.rank(scores(spark, rows)).where("clip_id = 3").orderBy("rank").collect()] == [1, 2]


def test_clips_without_scores(spark):
    clips = spark.createDataFrame([(1,), (2,)], "clip_id long")
    got = {r["clip_id"]: r for r in decide.decisions(scores(spark, [(1, 1, 1, 1.0), (1, 1, 2, 0.0)]), clips).collect()}
    assert got[2]["final"] == UNKNOWN and got[2]["margin"] == 0 and got[1]["final"] == "1"
    assert decide.top(scores(spark, [(1, 1, 1, 1.0)])).first()["top2"] == ""


def test_single_clip_class_is_absent_from_its_fold(spark):
    p = P.but(n_bins=2, min_clips=1)
    pcd = histograms(spark, [(1, 1, [1, 0]), (2, 2, [0.5, 0.5]), (3, 2, [0, 1])])
    got = {(r["clip_id"], r["model"]) for r in evaluate.loo_scores(pcd, p).collect()}
    assert (1, 1) not in got and (1, 2) in got and (2, 2) in got


def test_tallies_add_up(spark):
    rows = [(1, 1, 1, 0.9), (1, 1, 2, 0.1), (2, 1, 1, 0.1), (2, 1, 2, 0.9), (3, 2, 1, 0.5), (3, 2, 2, 0.5)]
    results = evaluate.outcomes(scores(spark, rows), Params())
    by = {r["raga"]: r for r in evaluate.per_class(results).collect()}
    assert (by[1]["correct"], by[1]["wrong"], by[1]["unknown"]) == (1, 1, 0) and by[2]["acc_decided"] == 0
    wide = {r["raga"]: r for r in evaluate.confusion(results, [1, 2]).collect()}
    assert wide[1]["1"] + wide[1]["2"] + wide[1]["UNKNOWN"] == 2 and wide[2]["UNKNOWN"] == 1
    assert sinks.summary(evaluate.overall(results)).first()["value"].startswith("files: 3")


def test_cohens_d(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0)], "g string, x double")
    assert stats.cohens_d(df, "x", "g", "a", "b").first()["d"] is None
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", 1.0), ("b", 3.0)], "g string, x double")
    assert stats.cohens_d(df, "x", "g", "a", "b").first()["d"] == pytest.approx(1 / math.sqrt(2))


def test_permutation_test_is_repeatable(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(6)] + [("b", float(i + 10)) for i in range(6)], "g string, x double")
    a, b = (stats.permutation_test(df, "x", "g", "a", "b", 1000).first()["p"] for _ in range(2))
    assert a == b and a < 0.05


def test_names(spark):
    name = "Foo.vocal-s_20250101_120000.npz"
    assert one(spark, name, names.song, "string") == "foo"
    assert one(spark, name, names.isolation, "string") == "STEM"
    assert one(spark, "a/B/c.MP3", names.extension, "string") == "mp3"
    assert one(spark, "a\\B\\c.mp3", lambda x: names.path_part(x, 2), "string") == "B"
    assert one(spark, "Kalyāṇi", names.class_name, "string") == "Kalyani"
    assert one(spark, "Tōḍi", names.class_name, "string") == "Thodi"
    assert one(spark, "Unheard", names.class_name, "string") == "Unheard"


def test_latest_cached(spark):
    files = spark.createDataFrame([("a_b_20250101_000000.npz", "v1"), ("a_b_20250102_000000.npz", "v1"), ("a_b_x.npz", "v1"), ("a_20250103_000000.npz", "v0")], "name string, feature_version string")
    got = listing.latest_cached(files, spark.createDataFrame([("a_b",), ("a",)], "base string"), "v1").collect()
    assert [(r["base"], r["name"]) for r in got] == [("a_b", "a_b_20250102_000000.npz")]


def test_best_of_duplicates_prefers_stems(spark):
    files = spark.createDataFrame([("r", "x.vocal_20250101_000000.npz", 0.5), ("r", "x.demucs-vocal_20250101_000000.npz", 0.55), ("r", "x.mp3_20250101_000000.npz", 0.9)], "raga string, fname string, gating double")
    got = {r["fname"]: r["kept"] for r in quality.best_of_duplicates(files).collect()}
    assert got == {"x.vocal_20250101_000000.npz": True, "x.demucs-vocal_20250101_000000.npz": False, "x.mp3_20250101_000000.npz": True}


def test_pitch_arrays_become_frames(spark):
    clips = spark.createDataFrame([(1, 2, [100.0, float("nan")], [True, False])], "clip_id long, raga int, f0 array<double>, voiced_flag array<boolean>")
    assert [tuple(r) for r in adapters.long_frames(clips).orderBy("frame_idx").collect()] == [(1, 2, 0, 100.0, True), (1, 2, 1, None, False)]


def test_histograms_sum_to_one(spark):
    df = features.histogram(tonic.folded(adapters.frames(spark.read.parquet("/root/testdata/sf0.001/events.parquet")), sa=100.0), Params())
    assert all(abs(r["s"] - 1) < 1e-9 for r in df.groupBy("clip_id").agg(F.sum("p").alias("s")).collect())


def test_note_ranges_and_entropy(spark):
    pcd = histograms(spark, [(1, 1, [0.25, 0.25, 0.5])])
    notes = spark.createDataFrame([("a", 0, 1), ("b", 2, 2)], "note string, lo int, hi int")
    assert {r["note"]: r["energy"] for r in scoring.note_energy(pcd, notes).collect()} == {"a": 0.5, "b": 0.5}
    assert scoring.entropy(pcd).first()["bits"] == pytest.approx(1.5)
