"""Keyed containment, the distributed permutation test, array leave-one-out and sparse distances, by plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchloom.functions import names
from pitchloom.operators import decide, evaluate, models, quality, scoring, stats
from pitchloom.params import UNKNOWN, Params


def words(seed, n, letters="ab-", most=9):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def test_containing_equals_all_pairs(spark):
    texts, parts = [*words(1, 60), None, "über", "éab"], [*words(2, 60, most=6), None, "be", "éa"]
    a = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    b = spark.createDataFrame(list(enumerate(parts)), "j long, p string")
    got = sorted((r["i"], r["j"]) for r in quality.containing(a, "t", b, "p").collect())
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(parts) if t is not None and p is not None and p in t)


def test_titles_that_begin_alike_meet_few_texts(spark):
    rnd = random.Random(5)
    some = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    titles = ["raga" + some(rnd.randint(3, 8)) for _ in range(10_000)]
    texts = [some(20) + rnd.choice(titles) + some(10) if k % 2 else "raga" + some(25) for k in range(1500)]
    a = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    b = spark.createDataFrame(list(enumerate(titles)), "j long, p string")
    got = sorted((r["i"], r["j"]) for r in quality.containing(a, "t", b, "p").collect())
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(titles) if p in t)
    strings = lambda df, c, h: df.select(F.col(c).alias("_text" if c == "t" else "_part"), F.xxhash64(c).alias(h)).distinct()
    # All begin with the same four letters: by these, 10,000 titles would meet some 1500 texts.
    assert quality._candidates(strings(a, "t", "_t"), strings(b, "p", "_p")).count() < 300_000


def test_matches_equal_loops(spark):
    songs, titles = words(3, 50, "abc "), words(4, 30, "abc ", 5)
    entries = spark.createDataFrame(list(enumerate(songs)), "path long, song string")
    meta = spark.createDataFrame([(t, f"r{k % 4}", k) for k, t in enumerate(titles)], "title string, raga string, ord long")
    for both in (True, False):
        want = {}
        for i, s in enumerate(songs):
            hit = next((k for k, t in enumerate(titles) if t in s or both and s in t), None)
            if hit is not None:
                want[i] = f"r{hit % 4}"
        assert {r["path"]: r["raga"] for r in quality.first_match(entries, meta, both).collect()} == want


def test_not_extracted_with_short_and_long_names(spark):
    staged = ["a/short.mp3", "a/" + "x" * 25 + ".mp3", "b/" + "y" * 20 + "zz.wav", "c/none.mp3", "d/.mp3"]
    existing = ["My SHORT song", "pre" + "X" * 24, "y" * 19]
    got = {r["path"] for r in quality.not_extracted(spark.createDataFrame([(s,) for s in staged], "path string"), spark.createDataFrame([(s,) for s in existing], "base string")).collect()}
    assert got == {"b/" + "y" * 20 + "zz.wav", "c/none.mp3"}


def test_new_classes_both_ways(spark):
    found, old = ["Kalyani Two", "to", "Saveri", "abc"], ["Kalyani", "Todi"]
    got = {r["raga"] for r in quality.new_classes(spark.createDataFrame([(x,) for x in found], "raga string"), spark.createDataFrame([(x,) for x in old], "raga string")).collect()}
    assert got == {"Saveri", "abc"}


@pytest.mark.parametrize("per_block", [100, 3, 1])
def test_permutation_test_equals_the_exact_share(spark, per_block):
    a, b = [5.0, 7.0, 7.0, 9.0], [1.0, 2.0, 4.0, 6.0, 7.0]
    pool, seen = a + b, abs(np.mean(a) - np.mean(b))
    exact = np.mean([abs(np.mean([pool[i] for i in c]) - np.mean([pool[i] for i in range(9) if i not in c])) >= seen - 1e-9 for c in itertools.combinations(range(9), 4)])
    rows = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b] + [("c", 99.0), ("a", None)], "g string, x double")
    got = stats.permutation_test(rows, "x", "g", "a", "b", iterations=20_000, per_block=per_block).first()
    assert abs(got["p"] - exact) < 4 * math.sqrt(exact * (1 - exact) / 20_000) and (got["n_a"], got["n_b"]) == (4, 5)
    assert got["p"] == stats.permutation_test(rows.repartition(5), "x", "g", "a", "b", iterations=20_000, per_block=per_block).first()["p"]


def test_permutation_test_of_an_empty_group(spark):
    rows = spark.createDataFrame([("a", 1.0)], "g string, x double")
    assert stats.permutation_test(rows, "x", "g", "a", "b").first()["p"] is None


def test_draws_follow_the_distribution():
    from math import comb

    u = stats.uniforms(7, 2, 11, np.arange(200_000))
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.004 and abs(u.var() - 1 / 12) < 0.002
    assert abs(np.corrcoef(u, stats.uniforms(7, 2, 12, np.arange(200_000)))[0, 1]) < 0.01
    for total, marked, m in ((9, 4, 3), (30, 1, 29), (50, 20, 25), (10, 10, 4), (6, 0, 3)):
        got = np.bincount(stats.hypergeometric(total, marked, np.full(len(u), m), u), minlength=marked + 1) / len(u)
        want = [comb(marked, x) * comb(total - marked, m - x) / comb(total, m) if x <= m and m - x <= total - marked else 0 for x in range(marked + 1)]
        assert np.abs(got - want).max() < 0.006
    # A value of a billion rows is one draw: no array of its copies is made.
    many = stats.hypergeometric(4 * 10**9, 10**9, np.full(2000, 10**9), u[:2000])
    assert abs(many.mean() - 2.5e8) < 2000 and 0.9 < many.std() / math.sqrt(1e9 * 0.25 * 0.75 * 0.75) < 1.1


def test_permutation_of_counts(spark):
    heavy = spark.range(2).select(F.when(F.col("id") == 0, "a").otherwise("b").alias("g"), F.explode(F.array_repeat(F.col("id").cast("double"), 50_000)).alias("x"))
    rows = heavy.unionByName(spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "g string, x double"))
    one = stats.permutation_test(rows, "x", "g", "a", "b", iterations=3000).first()
    assert one["p"] == 1 / 3001 and (one["n_a"], one["n_b"]) == (50_001, 50_000)


def test_separation_pools_references_with_duplicates(spark):
    rows = spark.createDataFrame([("t", 1.0), ("t", 2.0), ("r", 5.0), ("r", 6.0), ("s", 1.0), ("s", 1.5)], "g string, x double")
    one = lambda refs: stats.separation_test(rows, "x", "g", "t", refs, iterations=2000).first()
    assert one(["r", "s"])["reference_median"] == 3.25 and one(["r", "s", "s"])["reference_median"] == 1.5
    assert one(["s"])["verdict"] == "NO DEGRADATION" and one(["r"] * 6)["verdict"] == "WORSE"


def table_of(spark, rng, clips, bins):
    x = rng.dirichlet(np.ones(bins) * 0.3, clips)
    x[x < 0.02] = 0
    ragas = rng.integers(0, 4, clips)
    rows = [(i, int(ragas[i]), b, float(x[i, b])) for i in range(clips) for b in range(bins) if x[i, b] > 0]
    return x, ragas, spark.createDataFrame(rows, "clip_id long, raga int, bin int, p double")


@pytest.mark.parametrize("renormalise, kind", [(False, "idf_variance"), (True, "idf_variance"), (False, "idf_old")])
def test_loo_in_arrays_equals_rebuilt_models(spark, renormalise, kind):
    rng = np.random.default_rng(7)
    p = Params().but(n_bins=9, min_clips=2)
    x, ragas, pcd = table_of(spark, rng, 14, 9)
    x = np.vstack([x, x[:1]])
    ragas = np.append(ragas, 9)  # a class of one clip takes no part
    pcd = pcd.union(spark.createDataFrame([(14, 9, b, float(x[14, b])) for b in range(9) if x[14, b] > 0], pcd.schema))
    ok = [r for r in set(ragas.tolist()) if (ragas == r).sum() >= 2]
    want = {}
    for i in range(15):
        if ragas[i] in ok:
            train = np.arange(15) != i
            means = {r: x[train & (ragas == r)].mean(axis=0) for r in ok if (train & (ragas == r)).any()}
            if renormalise:
                means = {r: m / (m.sum() + p.eps) for r, m in means.items()}
            all_ = np.array(list(means.values()))
            level, plus = (0.001, 0) if kind == "idf_old" else (1 / 9, 1)
            w = (np.log(len(all_) / ((all_ > level).sum(axis=0) + 1)) + plus) / (all_.std(axis=0) + p.eps)
            w = w / (w.sum() + p.eps) * 9
            a = x[i] * w / ((x[i] * w).sum() + p.eps)
            for r, m in means.items():
                want[i, r] = (a @ (m * w / ((m * w).sum() + p.eps)), x[i][2:5].sum(), m[2:5].sum())
    got = {(r["clip_id"], r["model"]): (r["pcd_sim"], r["t_e"], r["m_e"]) for r in evaluate.loo_pcd(pcd, p, renormalise, kind, {"e": (2, 4)}).collect()}
    assert set(got) == set(want)
    for key, values in want.items():
        assert np.allclose(got[key], values, rtol=1e-9, atol=1e-12), key


def test_sparse_distance_equals_the_dense_one(spark):
    rng = np.random.default_rng(8)
    a, b = rng.random((4, 12)) * (rng.random((4, 12)) < 0.4), rng.random((3, 12)) * (rng.random((3, 12)) < 0.4)
    a[0] = 0
    a[0, 0], b[:, 0] = 1.0, 0.0  # nothing in common
    a[1:, 5] = b[:, 5] = 0.3
    clips = spark.createDataFrame([(i, k // 4, k % 4, float(v)) for i, row in enumerate(a) for k, v in enumerate(row) if v > 0], "clip_id long, frm int, to int, q double")
    classes = spark.createDataFrame([(i, k // 4, k % 4, float(v)) for i, row in enumerate(b) for k, v in enumerate(row) if v > 0], "model int, frm int, to int, m double")
    got = {(r["clip_id"], r["model"]): r["distance"] for r in scoring.sparse_jensen_shannon(clips, classes, ["frm", "to"]).collect()}
    gain = lambda x, m: sum(u * math.log(u / v) for u, v in zip(x, m) if u > 0)
    for i, j in itertools.product(range(4), range(3)):
        x, y = a[i] / a[i].sum(), b[j] / b[j].sum()
        mid = (x + y) / 2
        assert abs(got[i, j] - math.sqrt((gain(x, mid) + gain(y, mid)) / 2)) < 1e-9


def test_siblings_go_over_to_the_second_distances(spark):
    form = "clip_id long, model string, distance double"
    first = spark.createDataFrame([(1, "a", 0.10), (1, "b", 0.12), (1, "c", 0.9), (2, "a", 0.1), (2, "c", 0.12), (2, "b", 0.9), (3, "a", 0.1), (3, "b", 0.5)], form)
    second = spark.createDataFrame([(1, "a", 0.4), (1, "b", 0.2), (1, "c", 0.9), (2, "a", 0.9), (2, "c", 0.1), (2, "b", 0.5), (3, "b", 0.0), (3, "a", 0.9)], form)
    siblings = spark.createDataFrame([("a", "b"), ("b", "a")], "best string, sibling string")
    got = {r["clip_id"]: (r["final"], r["escalated"]) for r in decide.sibling_escalated(first, second, siblings).collect()}
    assert got == {1: ("b", True), 2: (UNKNOWN, False), 3: ("a", False)}


def test_mean_shares_and_words(spark):
    counts = spark.createDataFrame([(1, 0, 0, 3), (1, 0, 1, 1), (2, 0, 0, 1), (3, 1, 0, 5)], "clip_id long, raga int, bin int, cnt long")
    ok = spark.createDataFrame([(0, 2)], "raga int, clip_count long")
    assert {(r["model"], r["bin"]): r["m"] for r in models.mean_shares(counts, ok, ["bin"]).collect()} == {(0, 0): 0.875, (0, 1): 0.125}
    rows = spark.createDataFrame([("A Mix.wav",), ("solo.wav",), (None,)], "f string")
    assert [r["f"] for r in names.without_words(rows, "f", ["mix"]).collect()] == ["solo.wav", None]
