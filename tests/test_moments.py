"""Increments against one run over all clips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchloom.operators import models, moments
from pitchloom.params import Params
from pitchloom.sources import listing, sinks

P = Params().but(n_bins=6, min_clips=2, alpha=0.3)


@pytest.fixture(scope="module")
def clips(spark):
    rng = np.random.default_rng(3)
    pcd, counts, totals, dense = [], [], [], {}
    for clip in range(14):
        raga = clip % 3 if clip else 9
        x = np.where(rng.random(6) < 0.5, rng.random(6), 0)
        x[clip % 6] += 1e6 if raga == 1 else 0.1  # a large common part, small deviations
        pcd += [(clip, raga, b, float(v)) for b, v in enumerate(x) if v]
        for way in ("up", "down"):
            if clip == 5:  # a clip without a matrix
                continue
            c = np.where(rng.random((6, 6)) < 0.2, rng.integers(1, 9, (6, 6)), 0)
            s = float(c.sum())
            z = s + 0.3 * 36 + 1e-8
            totals.append((clip, raga, way, s, z))
            counts += [(clip, raga, way, int(i), int(j), int(c[i, j])) for i, j in zip(*np.nonzero(c))]
            dense[clip, way] = (c + 0.3) / z
    frame = spark.createDataFrame
    return frame(pcd, "clip_id long, raga int, bin int, p double"), frame(counts, "clip_id long, raga int, dir string, frm int, to int, cnt long"), frame(totals, "clip_id long, raga int, dir string, s double, z double"), dense


def run(spark, clips, path, groups):
    for k, group in enumerate(groups):
        sinks.write_increment(moments.increment(*[df.where(F.col("clip_id").isin(group)) for df in clips[:3]]), path, f"run{k}")
    return listing.increments(spark, path, moments.PARTS)


GROUPS = [[0, 1, 2, 3], [4], [5, 6, 7], [8, 9, 10, 11, 12, 13]]


def test_increments_equal_one_run(spark, clips, tmp_path):
    many, one = run(spark, clips, str(tmp_path / "many"), GROUPS), run(spark, clips, str(tmp_path / "one"), [sum(GROUPS, [])])
    get = lambda df, *keys: {tuple(r[k] for k in keys): r for r in df.collect()}
    whole = get(models.models(clips[0], P), "raga", "bin")
    for parts in (many, one):
        got = get(moments.models(parts, P), "raga", "bin")
        assert got.keys() == whole.keys()
        assert all(got[k][c] == pytest.approx(whole[k][c], rel=1e-12, abs=1e-12) for k in got for c in ("mean", "std", "clip_count"))
    cells, scalars = models.dyad_models(*clips[1:3], models.clip_counts(clips[0]), P)
    got_cells, got_scalars = moments.dyad_models(many, P)
    a, b = get(cells, "raga", "dir", "frm", "to"), get(got_cells, "raga", "dir", "frm", "to")
    assert a.keys() == b.keys() and all(b[k]["m"] == pytest.approx(a[k]["m"], rel=1e-12) for k in a)
    a, b = get(scalars, "raga", "dir"), get(got_scalars, "raga", "dir")
    assert a.keys() == b.keys() and all(b[k][c] == pytest.approx(a[k][c], rel=1e-12) for k in a for c in ("u", "v"))


def test_deviations_of_smoothed_cells(spark, clips, tmp_path):
    cells, scalars = moments.dyad_models(run(spark, clips, str(tmp_path), GROUPS), P)
    zero = np.zeros((6, 6))
    for raga in (0, 1, 2):
        for way in ("up", "down"):
            v = np.array([clips[3].get((c, way), zero) for c in range(1, 14) if c % 3 == raga])
            for r in cells.where(f"raga = {raga} and dir = '{way}'").collect():
                assert (r["mean"], r["std"]) == pytest.approx((v[:, r["frm"], r["to"]].mean(), v[:, r["frm"], r["to"]].std()), rel=1e-10)


def test_a_broken_run_is_left_out_and_clips_are_taken_once(spark, clips, tmp_path):
    path = str(tmp_path)
    run(spark, clips, path, GROUPS[:2])
    parts = moments.increment(*[df.where("clip_id > 9") for df in clips[:3]])
    parts["bins"].write.parquet(f"{path}/bins/run_id=broken")
    found = listing.increments(spark, path, moments.PARTS)
    assert {r["run_id"] for r in found["bins"].select("run_id").distinct().collect()} == {"run0", "run1"}
    left = listing.not_included(clips[0].select("clip_id").distinct(), found["clips"])
    assert {r["clip_id"] for r in left.collect()} == set(range(5, 14))
    with pytest.raises(Exception):
        sinks.write_increment(parts, path, "run1")
