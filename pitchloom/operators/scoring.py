"""Similarity of clips to class models, as DataFrame-to-DataFrame functions.

A clip meets only the bins it has: the dense product of clips and classes is an
equi-join on the bin with the broadcast models, whose size is bounded by classes
times bins. All terms come from one aggregation by clip and class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchloom.params import Params

DENSE = ("mean_sub",)


def pcd_similarity(pcd: DataFrame, model: DataFrame, p: Params = Params(), method: str = "weighted", weight: DataFrame | None = None) -> DataFrame:
    """``clip_id, raga, model, pcd_sim``.

    * ``dot``: sum of products;
    * ``cosine``: the same over both norms;
    * ``weighted``: dot of weighted vectors, each scaled to sum 1 again;
    * ``weighted_raw``: dot of weighted vectors;
    * ``mean_sub``: dot after subtracting the mean over the classes.
    """
    m = model.select(F.col("raga").alias("model"), "bin", F.col("mean").alias("mu"))
    if method == "mean_sub":
        centre = m.groupBy("bin").agg(F.avg("mu").alias("c"))
        centred = m.join(centre, "bin").withColumn("mu", F.col("mu") - F.col("c"))
        # The clip's own deviation is p - c also in bins that it lacks.
        terms = pcd.join(F.broadcast(centred), "bin").groupBy("clip_id", "raga", "model").agg(F.sum(F.col("p") * F.col("mu")).alias("x"))
        missing = centred.groupBy("model").agg(F.sum(F.col("c") * F.col("mu")).alias("y"))
        return terms.join(F.broadcast(missing), "model").select("clip_id", "raga", "model", (F.col("x") - F.col("y")).alias("pcd_sim"))
    if method in ("weighted", "weighted_raw"):
        m = m.join(F.broadcast(weight), "bin")
    else:
        m = m.withColumn("weight", F.lit(1.0))
    sides = m.groupBy("model").agg(F.sum(F.col("mu") * F.col("weight")).alias("sm"), F.sqrt(F.sum(F.col("mu") ** 2)).alias("nm"))
    joined = pcd.join(F.broadcast(m), "bin")
    agg = joined.groupBy("clip_id", "raga", "model").agg(
        F.sum(F.col("p") * F.col("mu") * F.col("weight") ** 2).alias("x"), F.sum(F.col("p") * F.col("weight")).alias("sp"), F.sqrt(F.sum(F.col("p") ** 2)).alias("np")
    )
    rows = agg.join(F.broadcast(sides), "model")
    scale = {"weighted": (F.col("sp") + p.eps) * (F.col("sm") + p.eps), "cosine": (F.col("np") + p.eps) * (F.col("nm") + p.eps)}.get(method, F.lit(1.0))
    return rows.select("clip_id", "raga", "model", (F.col("x") / scale).alias("pcd_sim"))


def dyad_similarity(counts: DataFrame, totals: DataFrame, cells: DataFrame, scalars: DataFrame, p: Params = Params()) -> DataFrame:
    """``clip_id, model, dyad_sim``: half the sum of both directions' dot products with the smoothed means.

    With counts ``A``, total ``s``, normaliser ``z`` of a clip, a product is
    ``(sum(A m) + alpha u s + alpha v + alpha^2 N^2 u) / z``: only cells that both have are joined.
    """
    hits = counts.join(cells.withColumnRenamed("raga", "model"), ["dir", "frm", "to"]).groupBy("clip_id", "model", "dir").agg(F.sum(F.col("cnt") * F.col("m")).alias("x"))
    base = totals.select("clip_id", "dir", "s", "z").join(F.broadcast(scalars.withColumnRenamed("raga", "model")), "dir")
    rows = base.join(hits, ["clip_id", "model", "dir"], "left")
    a, n2 = p.alpha, p.n_bins**2
    dot = (F.coalesce("x", F.lit(0.0)) + a * F.col("u") * F.col("s") + a * F.col("v") + a * a * n2 * F.col("u")) / F.col("z")
    return rows.groupBy("clip_id", "model").agg((0.5 * F.sum(dot)).alias("dyad_sim"))


def sparse_dot(clips: DataFrame, classes: DataFrame, p: Params = Params()) -> DataFrame:
    """``clip_id, model, dir, dot``: product of each clip's smoothed matrix with each class's smoothed mean.

    ``clips`` has ``clip_id, dir, s, z, cells`` and ``classes`` ``model, dir, u, v, cells``
    (see :func:`~pitchloom.operators.models.dyad_models`), with ``cells`` a map of cell to
    count or mean. Classes are few and are broadcast; no two clips ever meet.
    """
    n2, al = p.n_bins**2, p.alpha
    common = F.aggregate(F.map_entries("a_cells"), F.lit(0.0), lambda t, e: t + e["value"] * F.coalesce(F.element_at(F.col("b_cells"), e["key"]), F.lit(0.0)))
    a = clips.select("clip_id", "dir", "s", "z", F.col("cells").alias("a_cells"))
    rows = a.join(F.broadcast(classes.select("model", "dir", "u", "v", F.col("cells").alias("b_cells"))), "dir")
    return rows.select("clip_id", "model", "dir", ((common + al * F.col("u") * F.col("s") + al * F.col("v") + al * al * n2 * F.col("u")) / F.col("z")).alias("dot"))


def blend(pcd_sim: DataFrame, dyad_sim: DataFrame | None, p: Params = Params(), overrides: DataFrame | None = None) -> DataFrame:
    """``clip_id, raga, model, pcd_sim, dyad_sim, score``.

    ``overrides`` may have ``model, pcd_w, dyad_w`` rows for single classes. A clip
    without transitions has dyad similarity 0.
    """
    rows = pcd_sim.withColumn("dyad_sim", F.lit(0.0)) if dyad_sim is None else pcd_sim.join(dyad_sim, ["clip_id", "model"], "left").withColumn("dyad_sim", F.coalesce("dyad_sim", F.lit(0.0)))
    a, b = F.lit(p.pcd_weight), F.lit(p.dyad_weight)
    if overrides is not None:
        rows = rows.join(F.broadcast(overrides), "model", "left")
        a, b = F.coalesce("pcd_w", a), F.coalesce("dyad_w", b)
    return rows.select("clip_id", "raga", "model", "pcd_sim", "dyad_sim", (a * F.col("pcd_sim") + b * F.col("dyad_sim")).alias("score"))


def model_pairs(model: DataFrame, p: Params = Params(), weight: DataFrame | None = None, dyads: DataFrame | None = None) -> DataFrame:
    """``model, other, sim`` for all ordered pairs of different classes (classes times classes rows)."""
    m = model.select("raga", "bin", F.col("mean").alias("mu"))
    m = m.join(F.broadcast(weight), "bin").withColumn("x", F.col("mu") * F.col("weight")) if weight is not None else m.withColumn("x", F.col("mu"))
    if weight is not None:
        sums = m.groupBy("raga").agg((F.sum("x") + p.eps).alias("sx"))
        m = m.join(F.broadcast(sums), "raga").withColumn("x", F.col("x") / F.col("sx"))
    a, b = m.select(F.col("raga").alias("model"), "bin", F.col("x").alias("xa")), m.select(F.col("raga").alias("other"), "bin", F.col("x").alias("xb"))
    sims = a.join(b, "bin").where("model <> other").groupBy("model", "other").agg(F.sum(F.col("xa") * F.col("xb")).alias("pcd_sim"))
    if dyads is None:
        return sims.select("model", "other", F.col("pcd_sim").alias("sim"))
    rows = sims.join(dyads, ["model", "other"], "left")
    return rows.select("model", "other", (p.pcd_weight * F.col("pcd_sim") + p.dyad_weight * F.coalesce("dyad_sim", F.lit(0.0))).alias("sim"))


def hubness(pairs: DataFrame) -> DataFrame:
    """``model, avg_sim, global_mean``: how near each class is to all others."""
    by = pairs.groupBy("model").agg(F.avg("sim").alias("avg_sim"))
    return by.join(F.broadcast(by.agg(F.avg("avg_sim").alias("global_mean"))))


def centred(scores: DataFrame, hubs: DataFrame) -> DataFrame:
    """Scores less the class's mean similarity, plus the overall mean."""
    return scores.join(F.broadcast(hubs), "model", "left").withColumn("score", F.col("score") - F.col("avg_sim") + F.col("global_mean")).drop("avg_sim", "global_mean")


def absent_by_model(scores: DataFrame, pcd: DataFrame, model: DataFrame, penalty: float = 0.2, expected: float = 2.0, absent: float = 0.005) -> DataFrame:
    """Scores cut by the share of a class's expected bins that a clip hardly has.

    Expected are bins over ``expected`` times the median of the class's positive bins.
    """
    medians = model.where("mean > 0").groupBy("raga").agg(F.median("mean").alias("med"))
    bins = model.join(F.broadcast(medians), "raga").where(F.col("mean") > expected * F.col("med")).select(F.col("raga").alias("model"), "bin")
    counts = bins.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    present = pcd.where(F.col("p") >= absent).join(F.broadcast(bins), "bin").groupBy("clip_id", "model").agg(F.count(F.lit(1)).alias("has"))
    return _penalised(scores.join(F.broadcast(counts), "model", "left").join(present, ["clip_id", "model"], "left"), penalty)


def _penalised(rows: DataFrame, penalty: float) -> DataFrame:
    share = F.coalesce((F.col("n") - F.coalesce("has", F.lit(0))) / F.col("n"), F.lit(0.0))
    return rows.withColumn("score", F.col("score") * (1 - penalty * share)).drop("n", "has")


def absent_by_dictionary(scores: DataFrame, pcd: DataFrame, ranges: DataFrame, required: DataFrame, penalty: float = 0.2, least: float = 0.01) -> DataFrame:
    """Scores cut by the share of a class's required notes whose bins a clip hardly has.

    ``ranges`` has ``note, lo, hi`` (both inclusive), ``required`` has ``model, note``.
    """
    energy = note_energy(pcd, ranges).where(F.col("energy") >= least)
    counts = required.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    present = energy.join(F.broadcast(required), "note").groupBy("clip_id", "model").agg(F.count(F.lit(1)).alias("has"))
    return _penalised(scores.join(F.broadcast(counts), "model", "left").join(present, ["clip_id", "model"], "left"), penalty)


def note_energy(pcd: DataFrame, ranges: DataFrame) -> DataFrame:
    """``clip_id, note, energy``: a clip's histogram over a range of bins; notes without any are absent."""
    each = ranges.select("note", F.explode(F.sequence("lo", "hi")).alias("bin"))
    return pcd.join(F.broadcast(each), "bin").groupBy("clip_id", "note").agg(F.sum("p").alias("energy"))


def window_energies(pcd: DataFrame, key: str, windows: dict[str, tuple[int, int]], value: str = "p") -> DataFrame:
    """``key`` and one column per window: the sum over its bins, both ends included."""
    return pcd.groupBy(key).agg(*[F.sum(F.when(F.col("bin").between(lo, hi), F.col(value)).otherwise(0.0)).alias(name) for name, (lo, hi) in windows.items()])


def ratio_boost(scores: DataFrame, pcd: DataFrame, model: DataFrame, windows: dict[str, tuple[int, int]], weight: float = 0.1, p: Params = Params()) -> DataFrame:
    """Scores raised by how well a clip's energies in some windows match the class's."""
    clip = window_energies(pcd, "clip_id", {f"t_{k}": v for k, v in windows.items()})
    own = window_energies(model, "raga", {f"m_{k}": v for k, v in windows.items()}, "mean").withColumnRenamed("raga", "model")
    rows = scores.join(clip, "clip_id").join(F.broadcast(own), "model")
    match: Column = F.lit(0.0)
    for k in windows:
        match = match + F.greatest(F.lit(0.0), 1 - F.abs(F.col(f"t_{k}") - F.col(f"m_{k}")) / (F.col(f"m_{k}") + p.eps))
    return rows.withColumn("score", F.col("score") * (1 + weight * match / len(windows))).select(scores.columns)


def entropy(pcd: DataFrame, key: str = "clip_id", value: str = "p") -> DataFrame:
    """``key, nats, bits, active``: entropies of a histogram and its bins over 0.005."""
    x = F.col(value)
    return pcd.where(x > 0).groupBy(key).agg((-F.sum(x * F.ln(x + 1e-10))).alias("nats"), (-F.sum(x * F.log2(x))).alias("bits"), F.count_if(x > 0.005).alias("active"))


def genericness_penalty(scores: DataFrame, entropies: DataFrame, by: str = "clip_id", weight: float = 0.05) -> DataFrame:
    """Scores less ``weight`` times the entropy of the clip (or, by ``model``, of the class)."""
    rows = entropies.select(F.col(entropies.columns[0]).alias(by), "nats")
    return scores.join(rows, by, "left").withColumn("score", F.col("score") - weight * F.coalesce("nats", F.lit(0.0))).drop("nats")


def overlap(model: DataFrame) -> DataFrame:
    """``model, other, overlap`` for pairs of classes: the sum of the lesser values."""
    a, b = model.select(F.col("raga").alias("model"), "bin", F.col("mean").alias("x")), model.select(F.col("raga").alias("other"), "bin", F.col("mean").alias("y"))
    return a.join(b, "bin").where("model < other").groupBy("model", "other").agg(F.sum(F.least("x", "y")).alias("overlap"))


def jensen_shannon(pcd: DataFrame, model: DataFrame) -> DataFrame:
    """``clip_id, raga, model, distance``: root of the divergence of two histograms, each scaled to sum 1; lower is nearer."""
    ps = pcd.withColumn("q", F.col("p") / F.sum("p").over(_by("clip_id")))
    ms = model.withColumn("m", F.col("mean") / F.sum("mean").over(_by("raga"))).select(F.col("raga").alias("model"), "bin", "m")
    mid = (F.col("q") + F.col("m")) / 2
    gain = lambda x: F.when(x > 0, x * F.ln(x / mid)).otherwise(0.0)
    # Bins that the clip lacks add m ln 2 / 2: all of them, less those it has.
    met = ps.join(F.broadcast(ms), "bin").groupBy("clip_id", "raga", "model").agg(F.sum(gain(F.col("q")) + gain(F.col("m"))).alias("s"), F.sum("m").alias("seen"))
    return met.select("clip_id", "raga", "model", F.sqrt(F.greatest(F.lit(0.0), (F.col("s") + (1 - F.col("seen")) * F.ln(F.lit(2.0))) / 2)).alias("distance"))


def sparse_jensen_shannon(clips: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """``clip_id, model, distance`` of two sparse distributions over ``keys``, each scaled to sum 1.

    ``clips`` has ``clip_id, *keys, q`` and ``classes`` ``model, *keys, m``. Cells that only
    one side has add half of their mass times ln 2, so that only common cells are joined.
    A pair without a common cell has the greatest distance. Classes' cells are bounded by
    classes times cells of a matrix.
    """
    ps = clips.withColumn("q", F.col("q") / F.sum("q").over(_by("clip_id")))
    ms = classes.withColumn("m", F.col("m") / F.sum("m").over(_by("model"))).select("model", *keys, "m")
    mid = (F.col("q") + F.col("m")) / 2
    gain = lambda x: F.when(x > 0, x * F.ln(x / mid)).otherwise(0.0)
    met = ps.join(ms, keys).groupBy("clip_id", "model").agg(F.sum(gain(F.col("q")) + gain(F.col("m"))).alias("s"), F.sum("m").alias("sm"), F.sum("q").alias("sq"))
    pairs = clips.select("clip_id").distinct().crossJoin(F.broadcast(classes.select("model").distinct()))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = pairs.join(met, ["clip_id", "model"], "left")
    return rows.select("clip_id", "model", F.sqrt(F.greatest(F.lit(0.0), (zero("s") + (2 - zero("sm") - zero("sq")) * F.ln(F.lit(2.0))) / 2)).alias("distance"))


def absent_energy(model: DataFrame, ranges: DataFrame, required: DataFrame) -> DataFrame:
    """``model, note, energy``: what each class's mean histogram has in the notes outside its scale.

    ``required`` has ``model, note``; classes without a scale are left out.
    """
    outside = required.select("model").distinct().crossJoin(ranges.select("note")).join(required, ["model", "note"], "left_anti")  # classes times notes
    have = note_energy(model.select(F.col("raga").alias("clip_id"), "bin", F.col("mean").alias("p")), ranges).withColumnRenamed("clip_id", "model")
    return outside.join(model.select(F.col("raga").alias("model")).distinct(), "model", "left_semi").join(have, ["model", "note"], "left").select("model", "note", F.coalesce("energy", F.lit(0.0)).alias("energy"))


def first_seen(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each combination of ``keys`` its first row in the given order."""
    return events.withColumn("_n", F.row_number().over(_by_many(keys).orderBy(*order))).where("_n = 1").drop("_n")


def _by_many(keys: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


def confidence(scores: DataFrame) -> DataFrame:
    """``clip_id, confidence``: best score less the mean of all."""
    return scores.groupBy("clip_id").agg((F.max("score") - F.avg("score")).alias("confidence"))


def wide(scores: DataFrame, labels: list, value: str = "score") -> DataFrame:
    """A row per clip, a column per class."""
    return scores.groupBy("clip_id").pivot("model", labels).agg(F.max(value))
