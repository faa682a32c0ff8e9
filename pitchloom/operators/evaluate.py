"""Evaluation: leave-one-out, resubstitution, confusion and accuracies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.operators import decide, scoring
from pitchloom.operators import models as M
from pitchloom.params import Params


def loo_pcd(pcd: DataFrame, p: Params = Params(), renormalise: bool = False, kind: str = "idf_variance", windows: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """``clip_id, raga, model, pcd_sim`` of each clip against models and weights made without it.

    Only the clip's own class differs from the models of all clips, so its mean is the
    whole mean less the clip: ``(n mean - p) / (n - 1)``; no fold is built from its
    training clips. The sums of all classes (classes times bins numbers) are broadcast as
    one row of arrays, and a clip's similarities are computed within its own row: nothing
    is exploded or shuffled but the clip's histogram, once. The classes' number of clips
    is checked before clips are held out; a class whose only clip is held out is absent.

    ``windows`` adds ``t_<name>`` and ``m_<name>``: what the clip and the fold's model have
    in those bins, both ends included.
    """
    ok = M.eligible(M.clip_counts(pcd), p)
    held = pcd.join(F.broadcast(ok.select("raga")), "raga", "left_semi")
    sums = held.groupBy("raga", "bin").agg(F.sum("p").alias("s"))
    grid = M.grid(ok, p).join(sums, ["raga", "bin"], "left").select(F.col("raga").alias("model"), "clip_count", F.struct("bin", F.coalesce("s", F.lit(0.0)).alias("s")).alias("b"))
    each = grid.groupBy("model", "clip_count").agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["s"]).alias("s"))
    each = each.withColumn("mean", F.transform("s", lambda y: F.greatest(F.lit(0.0), y) / F.col("clip_count")))
    whole = each.agg(F.array_sort(F.collect_list(F.struct("model", "clip_count", "s", "mean"))).alias("all"))
    clips = held.groupBy("clip_id", "raga").agg(F.map_from_entries(F.collect_list(F.struct("bin", "p"))).alias("v"))
    bins = F.sequence(F.lit(0), F.lit(p.n_bins - 1))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, y: t + y)
    dot = lambda xs, ys: total(F.zip_with(xs, ys, lambda y, z: y * z))
    rows = clips.crossJoin(F.broadcast(whole)).select("clip_id", "raga", "all", F.transform(bins, lambda b: F.coalesce(F.element_at("v", b), F.lit(0.0))).alias("x"))
    own = lambda m: m["model"] == F.col("raga")
    # Only the clip's own class is computed anew.
    less = lambda m: F.when(own(m), F.zip_with(m["s"], F.col("x"), lambda s, y: F.greatest(F.lit(0.0), s - y) / (m["clip_count"] - 1))).otherwise(m["mean"])
    rows = rows.select("clip_id", "raga", "x", F.transform(F.filter("all", lambda m: ~own(m) | (m["clip_count"] > 1)), lambda m: F.struct(m["model"].alias("model"), less(m).alias("mean"))).alias("ms"))
    if renormalise:
        rows = rows.withColumn("ms", F.transform("ms", lambda m: F.struct(m["model"].alias("model"), F.transform(m["mean"], lambda y: y / (total(m["mean"]) + p.eps)).alias("mean"))))
    level = 0.001 if kind == "idf_old" else 1.0 / p.n_bins
    # Sums over the models, bin by bin: arrays are added, and no bin is looked up by its number.
    over = lambda f: F.aggregate("ms", F.array_repeat(F.lit(0.0), p.n_bins), lambda t, m: F.zip_with(t, f(m), lambda y, z: y + z))
    k = F.size("ms")
    rows = rows.withColumn("avg", F.transform(over(lambda m: m["mean"]), lambda y: y / k))
    rows = rows.withColumn("ss", over(lambda m: F.zip_with(m["mean"], F.col("avg"), lambda y, z: (y - z) * (y - z)))).withColumn("df", over(lambda m: F.transform(m["mean"], lambda y: (y > level).cast("double"))))
    rows = rows.withColumn("w", F.zip_with("ss", "df", lambda y, z: (F.ln(k / (z + 1)) + (0 if kind == "idf_old" else 1)) / (F.sqrt(y / k) + p.eps)))
    # The scale of the weights cancels in the similarity but for eps, so it is applied to the sums.
    rows = rows.select("clip_id", "raga", "x", "ms", "w", F.zip_with("x", "w", lambda y, w: y * w).alias("xw"), (p.n_bins / (total("w") + p.eps)).alias("c"))
    rows = rows.select("clip_id", "raga", "x", "w", "c", F.zip_with("xw", "w", lambda y, w: y * w).alias("xww"), total("xw").alias("sp"), F.explode("ms").alias("m"))
    c = F.col("c")
    sim = dot(F.col("m.mean"), F.col("xww")) * c * c / ((F.col("sp") * c + p.eps) * (dot(F.col("m.mean"), F.col("w")) * c + p.eps))
    part = lambda xs, lo, hi: total(F.slice(xs, lo + 1, hi - lo + 1))
    more = [f(*w).alias(f"{side}_{name}") for name, w in (windows or {}).items() for side, f in (("t", lambda lo, hi: part("x", lo, hi)), ("m", lambda lo, hi: part(F.col("m.mean"), lo, hi)))]
    return rows.select("clip_id", "raga", F.col("m.model").alias("model"), sim.alias("pcd_sim"), *more)


def loo_scores(pcd: DataFrame, p: Params = Params(), counts: DataFrame | None = None, totals: DataFrame | None = None, renormalise: bool = False, kind: str = "idf_variance", windows: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """``clip_id, raga, model, pcd_sim, dyad_sim, score``: each clip against models made without it.

    The first part is :func:`loo_pcd`; with transition ``counts`` and ``totals`` the
    second is :func:`loo_dyads`, else 0.
    """
    counts_ = M.clip_counts(pcd)
    pcd_sim = loo_pcd(pcd, p, renormalise, kind, windows)
    if counts is None:
        return pcd_sim.select("*", F.lit(0.0).alias("dyad_sim"), (p.pcd_weight * F.col("pcd_sim")).alias("score"))
    dyad = loo_dyads(counts, totals, counts_, p)
    rows = pcd_sim.join(dyad, ["clip_id", "model"], "left").withColumn("dyad_sim", F.coalesce("dyad_sim", F.lit(0.0)))
    return rows.withColumn("score", p.pcd_weight * F.col("pcd_sim") + p.dyad_weight * F.col("dyad_sim"))


def loo_dyads(counts: DataFrame, totals: DataFrame, clip_counts: DataFrame, p: Params = Params()) -> DataFrame:
    """``clip_id, model, dyad_sim`` without the clip's own share in its class's means."""
    ok = M.eligible(clip_counts, p)
    cells, scalars = M.dyad_models(counts, totals, clip_counts, p)
    hits = counts.join(cells.withColumnRenamed("raga", "model"), ["dir", "frm", "to"]).groupBy("clip_id", "model", "dir").agg(F.sum(F.col("cnt") * F.col("m")).alias("x"))
    squares = counts.groupBy("clip_id", "dir").agg(F.sum(F.col("cnt") * F.col("cnt")).alias("own2"))
    base = totals.join(F.broadcast(ok.select("raga")), "raga", "left_semi").join(F.broadcast(scalars.withColumnRenamed("raga", "model")), "dir").join(F.broadcast(ok.select(F.col("raga").alias("model"), "clip_count")), "model")
    rows = base.join(hits, ["clip_id", "model", "dir"], "left").join(squares, ["clip_id", "dir"], "left")
    a, n2, n, z, s = p.alpha, p.n_bins**2, F.col("clip_count"), F.col("z"), F.col("s")
    own = F.col("model") == F.col("raga")
    less = lambda mean, mine: F.when(own, (n * mean - mine) / (n - 1)).otherwise(mean)
    x = less(F.coalesce("x", F.lit(0.0)), F.coalesce("own2", F.lit(0)) / z)
    u, v = less(F.col("u"), 1 / z), less(F.col("v"), s / z)
    dot = (x + a * u * s + a * v + a * a * n2 * u) / z
    return rows.where(~own | (n > 1)).groupBy("clip_id", "model").agg((0.5 * F.sum(dot)).alias("dyad_sim"))


def outcomes(scores: DataFrame, p: Params = Params()) -> DataFrame:
    """``clip_id, raga, predicted, margin, tier, outcome`` with outcome c, w or u."""
    # A clip has one class, so the two best of a clip and class are those of the clip.
    pair = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "model")))
    best = scores.groupBy("clip_id", "raga").agg(F.slice(pair, 1, 2).alias("t"))
    margin = F.coalesce(F.try_element_at("t", F.lit(2))["s"] - F.col("t")[0]["s"], F.lit(0.0))
    found = best.select("clip_id", "raga", F.col("t")[0]["model"].alias("best"), margin.alias("margin"))
    level = decide.tier(F.col("margin"), p)
    outcome = F.when(level == "UNKNOWN", "u").when(F.col("best") == F.col("raga"), "c").otherwise("w")
    return found.select("clip_id", "raga", F.col("best").alias("predicted"), "margin", level.alias("tier"), outcome.alias("outcome"))


def per_class(results: DataFrame) -> DataFrame:
    """``raga, total, correct, wrong, unknown, acc_all, acc_decided``; no decision gives accuracy 0."""
    is_ = lambda o: F.sum((F.col("outcome") == o).cast("long"))
    by = results.groupBy("raga").agg(F.count(F.lit(1)).alias("total"), is_("c").alias("correct"), is_("w").alias("wrong"), is_("u").alias("unknown"))
    return by.select("*", (F.col("correct") / F.col("total")).alias("acc_all"), _decided().alias("acc_decided"))


def _decided():
    done = F.col("correct") + F.col("wrong")
    return F.when(done > 0, F.col("correct") / done).otherwise(0.0)


def overall(results: DataFrame) -> DataFrame:
    """One row: totals, unknown rate and both accuracies."""
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    one = results.agg(F.count(F.lit(1)).alias("total"), is_("c").alias("correct"), is_("w").alias("wrong"), is_("u").alias("unknown"))
    return one.select("*", (F.col("unknown") / F.col("total")).alias("unknown_rate"), (F.col("correct") / F.col("total")).alias("acc_all"), _decided().alias("acc_decided"))


def confusion(results: DataFrame, labels: list) -> DataFrame:
    """A row per true class, a column per label and one for UNKNOWN, zeros filled in."""
    named = results.withColumn("said", F.when(F.col("outcome") == "u", "UNKNOWN").otherwise(F.col("predicted").cast("string")))
    columns = [*[str(x) for x in labels], "UNKNOWN"]
    return named.groupBy("raga").pivot("said", columns).agg(F.count(F.lit(1))).na.fill(0, columns)


def confusion_long(results: DataFrame) -> DataFrame:
    named = results.withColumn("said", F.when(F.col("outcome") == "u", "UNKNOWN").otherwise(F.col("predicted").cast("string")))
    return named.groupBy("raga", "said").agg(F.count(F.lit(1)).alias("n"))


def sinks(results: DataFrame, k: int | None = None) -> DataFrame:
    """``sink, n``: classes that wrong predictions fall into, most first."""
    wrong = results.where(F.col("outcome") == "w").groupBy(F.col("predicted").alias("sink")).agg(F.count(F.lit(1)).alias("n"))
    return wrong.orderBy(F.desc("n"), "sink").limit(k) if k else wrong


def named_sink(results: DataFrame, name) -> DataFrame:
    """One row: how many wrong predictions fall into one class."""
    return results.agg(F.count_if((F.col("outcome") == "w") & (F.col("predicted") == name)).alias("n"))


def tiers(results: DataFrame) -> DataFrame:
    """``raga, high, moderate, unknown, wrong, mean_margin``."""
    right = F.col("outcome") == "c"
    return results.groupBy("raga").agg(
        F.count_if(right & (F.col("tier") == "HIGH")).alias("high"), F.count_if(right & (F.col("tier") == "MODERATE")).alias("moderate"),
        F.count_if(F.col("outcome") == "u").alias("unknown"), F.count_if(F.col("outcome") == "w").alias("wrong"), F.avg("margin").alias("mean_margin"),
    )


def fixed_broken(base: DataFrame, new: DataFrame) -> DataFrame:
    """``clip_id, change``: wrong before but not after (fixed), or the other way (broken)."""
    a, b = base.where(F.col("outcome") == "w").select("clip_id"), new.where(F.col("outcome") == "w").select("clip_id")
    return a.subtract(b).withColumn("change", F.lit("fixed")).unionByName(b.subtract(a).withColumn("change", F.lit("broken")))


def sweep(params: DataFrame, scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Tallies for every row of ``params`` (``param, pcd_w, dyad_w, strict, least``), in one job.

    ``scores`` has ``clip_id, raga, model, pcd_sim, dyad_sim``, and ``keys`` if scores of
    several kinds are swept at once. The few parameter rows are broadcast.
    """
    rows = scores.crossJoin(F.broadcast(params)).withColumn("score", F.col("pcd_w") * F.col("pcd_sim") + F.col("dyad_w") * F.col("dyad_sim"))
    pair = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "model")))
    best = rows.groupBy(*keys, "param", "strict", "least", "clip_id", "raga").agg(F.slice(pair, 1, 2).alias("t"))
    margin = F.coalesce(F.try_element_at("t", F.lit(2))["s"] - F.col("t")[0]["s"], F.lit(0.0))
    out = F.when(margin < F.col("least"), "u").when(F.col("t")[0]["model"] == F.col("raga"), "c").otherwise("w")
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    by = best.withColumn("outcome", out).groupBy(*keys, "param").agg(is_("c").alias("correct"), is_("w").alias("wrong"), is_("u").alias("unknown"))
    return by.withColumn("acc_decided", _decided())


def scenarios(pcd: DataFrame, counts: DataFrame, totals: DataFrame, overrides: DataFrame, excluded: list, p: Params = Params()) -> DataFrame:
    """``scenario, clip_id, raga, predicted, margin, tier, outcome`` of three leave-one-out runs.

    ``all``: every class with the common weights; ``override``: with ``model, pcd_w,
    dyad_w`` rows for single classes; ``excluded``: without some classes, whose clips are
    neither models nor tested.
    """
    scores = loo_scores(pcd, p, counts, totals)
    sims = scores.select("clip_id", "raga", "model", "pcd_sim"), scores.select("clip_id", "model", "dyad_sim")
    without = lambda df: df.where(~F.col("raga").isin(excluded))
    runs = {"all": scores, "override": scoring.blend(*sims, p, overrides), "excluded": loo_scores(without(pcd), p, without(counts), without(totals))}
    out = None
    for name, rows in runs.items():
        one = outcomes(rows, p).select(F.lit(name).alias("scenario"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _tally(rows: DataFrame, p: Params, keys: list[str], sink=None) -> DataFrame:
    """Correct, wrong and unknown (and wrong ones that name ``sink``) by ``keys`` from ``*keys, clip_id, raga, model, score`` rows."""
    pair = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "model")))
    best = rows.groupBy(*keys, "clip_id", "raga").agg(F.slice(pair, 1, 2).alias("t"))
    margin = F.coalesce(F.try_element_at("t", F.lit(2))["s"] - F.col("t")[0]["s"], F.lit(0.0))
    out = F.when(margin < p.margin_min, "u").when(F.col("t")[0]["model"] == F.col("raga"), "c").otherwise("w")
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    into = [F.count_if((F.col("outcome") == "w") & (F.col("t")[0]["model"] == F.lit(sink))).alias("sink")] if sink is not None else []
    by = best.withColumn("outcome", out).groupBy(*keys).agg(is_("c").alias("correct"), is_("w").alias("wrong"), is_("u").alias("unknown"), *into)
    return by.withColumn("acc_decided", _decided())


def sweep_absent(scores: DataFrame, pcd: DataFrame, ranges: DataFrame, required: DataFrame, params: DataFrame, p: Params = Params()) -> DataFrame:
    """``penalty, least, correct, wrong, unknown, acc_decided`` for each row of ``params`` (``penalty, least``), in one job.

    A class's score is cut by ``penalty`` times the share of its required notes whose
    energy in the clip is under ``least``. The few parameter rows and the classes' notes
    are broadcast; energies are summed once.
    """
    energy = scoring.note_energy(pcd, ranges)
    met = energy.join(F.broadcast(required), "note").crossJoin(F.broadcast(params.select("least").distinct())).where(F.col("energy") >= F.col("least"))
    has = met.groupBy("least", "clip_id", "model").agg(F.count(F.lit(1)).alias("has"))
    n = required.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    rows = scores.select("clip_id", "raga", "model", "score").join(F.broadcast(n), "model", "left").crossJoin(F.broadcast(params)).join(has, ["least", "clip_id", "model"], "left")
    share = F.coalesce((F.col("n") - F.coalesce("has", F.lit(0))) / F.col("n"), F.lit(0.0))
    return _tally(rows.withColumn("score", F.col("score") * (1 - F.col("penalty") * share)), p, ["penalty", "least"])


def sweep_ratio(scores: DataFrame, names: list[str], params: DataFrame, p: Params = Params()) -> DataFrame:
    """``ratio_w, correct, wrong, unknown, acc_decided`` for each ``ratio_w`` of ``params``, in one job.

    ``scores`` has ``t_<name>`` and ``m_<name>`` (see :func:`loo_pcd`); 0 is the base line.
    """
    match = F.lit(0.0)
    for k in names:
        match = match + F.greatest(F.lit(0.0), 1 - F.abs(F.col(f"t_{k}") - F.col(f"m_{k}")) / (F.col(f"m_{k}") + p.eps))
    rows = scores.crossJoin(F.broadcast(params)).withColumn("score", F.col("score") * (1 + F.col("ratio_w") * match / len(names)))
    return _tally(rows, p, ["ratio_w"])


def sweep_bins(scores: DataFrame, p: Params = Params(), sink=None) -> DataFrame:
    """``n_bins, correct, wrong, unknown, sink, acc_decided`` by resubstitution for every number of bins, in one job.

    ``scores`` is made by :func:`~pitchloom.operators.resolutions.scores`; ``sink`` counts
    wrong answers that name this class.
    """
    return _tally(scores, p, ["n_bins"], sink)


def best_configuration(swept: DataFrame, param: str = "param") -> DataFrame:
    """One row: the configuration with most correct answers, then fewest wrong ones, then the greatest name."""
    return swept.agg(F.max_by(param, F.struct("correct", -F.col("wrong"), param)).alias(param), F.max("correct").alias("correct"))


def verdict(base: DataFrame, new: DataFrame) -> DataFrame:
    """One row: change of the decided accuracy between two :func:`overall` rows, in words."""
    delta = F.col("b.acc_decided") - F.col("a.acc_decided")
    return base.alias("a").crossJoin(new.alias("b")).select(delta.alias("delta"), F.when(delta > 0, "BETTER").when(delta == 0, "SAME").otherwise("WORSE").alias("verdict"))
