"""Registry of the core queries and their DuckDB oracles.

Queries run on the generic tables through the adapters, with parameters that suit
them: 12 bins, runs of 2 frames, small margins. Values are rounded here only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchloom.functions import names as G
from pitchloom.functions import pitch
from pitchloom.operators import decide, evaluate, features, gate, models, moments, quality, resolutions, scoring, segments, stats, tonic
from pitchloom.params import UNKNOWN, Params
from pitchloom.plans.oracle import decided, loo, q, with_dyads
from pitchloom.sources import adapters, archives, listing, sinks
from pitchloom.sources.adapters import table
from pitchloom.streaming import pieces

P = Params().but(n_bins=12, min_stable=2, min_voiced=20, margin_strict=8e-4, margin_min=2e-4)
V = Params().but(n_bins=64, margin_strict=6e-5, margin_min=2e-5)
SA = 100.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r(c, n: int = 6):
    """A double, rounded for comparison; -0 becomes 0."""
    name = c if isinstance(c, str) else None
    out = F.round(F.col(c) if name else c, n) + F.lit(0.0)
    return out.alias(name) if name else out


# --- inputs -----------------------------------------------------------------------


def _frames(spark, d):
    return adapters.frames(table(spark, d, "events"))


def _folded(spark, d):
    return tonic.folded(_frames(spark, d), sa=SA)


def _pcd(spark, d):
    return features.histogram(_folded(spark, d), P)


def _runs(spark, d):
    return features.runs(features.binned(_folded(spark, d), P))


def _dyads(spark, d):
    return features.dyads(features.transitions(_runs(spark, d), P))


def _parts(spark, d, p=P):
    """Histograms, transition counts and totals of the clips."""
    folded = _folded(spark, d)
    bins = features.binned(folded, p)
    counts = features.dyads(features.transitions(features.runs(bins), p))
    return features.histogram(folded, p), counts, features.dyad_totals(bins, counts, p)


def _scores(spark, d, p=P):
    pcd, counts, totals = _parts(spark, d, p)
    model = models.models(pcd, p)
    cells, scalars = models.dyad_models(counts, totals, models.clip_counts(pcd), p)
    sims = scoring.pcd_similarity(pcd, model, p, "weighted", models.weights(model, p))
    return scoring.blend(sims, scoring.dyad_similarity(counts, totals, cells, scalars, p), p)


def _vectors(spark, d):
    return adapters.vectors(table(spark, d, "embeddings"))


def _loo(spark, d):
    return evaluate.outcomes(evaluate.loo_scores(_vectors(spark, d), V), V)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to decisions: estimated tonics, models of the gated clips, scores, margins and tiers."""
    frames = _frames(spark, sf_dir)
    p = P.but(min_clips=1)
    folded = tonic.folded(frames, tonic.tonic(frames, p))
    trained = features.histogram(gate.gated_cents(gate.gate(folded, p)), p, p.eps)
    pcd = features.histogram(folded, p)
    model = models.models(trained, p)
    sims = scoring.pcd_similarity(pcd, model, p, "weighted", models.weights(model, p))
    return decide.decisions(scoring.blend(sims, None, p), frames.select("clip_id"), p).select("clip_id", "final", r("margin"), "confidence_tier")


# --- pitch, histograms, transitions -------------------------------------------------


@query(q("SELECT clip_id, raga, bin, round(p, 6) AS p FROM pcd", "pcd"))
def pcd_by_clip(spark, d):
    return _pcd(spark, d).select("clip_id", "raga", "bin", r("p"))


_TONIC = dict(
    v="SELECT clip_id, f0, min(f0) OVER (PARTITION BY clip_id) AS lo, max(f0) OVER (PARTITION BY clip_id) AS hi FROM frames WHERE f0 IS NOT NULL",
    h="SELECT clip_id, lo, hi, least(floor((f0 - lo) * 200 / (hi - lo)), 199) AS b, count(*) AS c FROM v GROUP BY ALL",
    k="SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY c DESC, b DESC) AS peak FROM h",
    o="SELECT clip_id, peak, m, (lo + (b + 0.5) * (hi - lo) / 200) * x AS hz FROM k, (VALUES (0, 0.5), (1, 1.0), (2, 2.0)) t(m, x) WHERE peak <= 5",
    s="SELECT o.clip_id, peak, m, hz, sum(CASE WHEN abs(1200 * log2(f0 / hz)) < 50 THEN 1 ELSE 0 END) AS score FROM o JOIN v USING (clip_id) WHERE hz BETWEEN 80 AND 400 GROUP BY ALL",
    t="SELECT clip_id, hz AS sa, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, peak DESC, m) AS rn FROM s) WHERE rn = 1 AND clip_id IN (SELECT clip_id FROM v GROUP BY clip_id HAVING count(*) >= 20)",
)


@query(q("SELECT clip_id, round(sa, 6) AS sa, score FROM t", "frames", **_TONIC))
def tonic_by_clip(spark, d):
    return tonic.tonic(_frames(spark, d), P).select("clip_id", r("sa"), "score")


@query(q("SELECT clip_id, round(median(f0), 6) AS sa FROM frames WHERE f0 IS NOT NULL GROUP BY clip_id", "frames"))
def tonic_median(spark, d):
    return tonic.median_tonic(_frames(spark, d)).select("clip_id", r("sa"))


@query(q("SELECT clip_id, round(lo + (b + 0.5) * (hi - lo) / 200, 6) AS sa FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY c DESC, b) AS rn FROM h) WHERE rn = 1", "frames", v=_TONIC["v"], h=_TONIC["h"]))
def tonic_peak(spark, d):
    return tonic.peak_tonic(_frames(spark, d), P).select("clip_id", r("sa"))


_NEAR = "SELECT clip_id, frame_idx, CASE WHEN least(cents, 1200 - cents) < 50 THEN 1.0 ELSE 0.0 END AS near FROM folded WHERE f0 IS NOT NULL"


@query(q("SELECT clip_id, round(avg(near), 6) AS density, round(coalesce(avg(near * nxt), 0), 6) AS continuity, round(0.7 * avg(near) + 0.3 * coalesce(avg(near * nxt), 0), 6) AS score FROM (SELECT *, lead(near) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS nxt FROM nr) GROUP BY clip_id", "folded", nr=_NEAR))
def tonic_validation(spark, d):
    frames = _frames(spark, d)
    fixed = frames.select("clip_id").distinct().withColumn("sa", F.lit(SA))
    return tonic.validated(frames, fixed).select("clip_id", r("density"), r("continuity"), r("score"))


_GATE = dict(
    g="SELECT *, coalesce(cents, 0) AS g, count(*) OVER (PARTITION BY clip_id) AS n FROM folded",
    ok="""SELECT *, frame_idx < n - 10 AND avg(CASE WHEN voiced THEN 1.0 ELSE 0.0 END) OVER (w ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) >= 0.6
       AND abs(avg(g) OVER (w ROWS BETWEEN 5 FOLLOWING AND 9 FOLLOWING) - avg(g) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) < 60 AS ok FROM g WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)""",
    kept="SELECT a.*, EXISTS (SELECT 1 FROM ok b WHERE b.clip_id = a.clip_id AND b.ok AND b.frame_idx BETWEEN a.frame_idx - 9 AND a.frame_idx) AS kept FROM ok a",
)


@query(q("SELECT clip_id, CAST(sum(CASE WHEN kept THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN voiced THEN 1 ELSE 0 END) AS BIGINT) AS voiced, round(sum(CASE WHEN kept THEN 1 ELSE 0 END) / (sum(CASE WHEN voiced THEN 1 ELSE 0 END) + 1e-8), 6) AS gating_ratio FROM kept GROUP BY clip_id", "folded", **_GATE))
def stability_gate(spark, d):
    p = P.but(drift=60.0)
    return gate.ratios(gate.gate(_folded(spark, d), p), p).select("clip_id", "kept", "voiced", r("gating_ratio"))


@query(ORACLES["stability_gate"])
def stability_gate_segmented(spark, d):
    p = P.but(drift=60.0)
    return gate.ratios(segments.gate(_folded(spark, d), p, 50), p).select("clip_id", "kept", "voiced", r("gating_ratio"))


@query(q("SELECT clip_id, round(sum(CASE WHEN voiced THEN 1 ELSE 0 END) / count(*), 6) AS gating_ratio FROM frames GROUP BY clip_id", "frames"))
def voiced_ratio_ungated(spark, d):
    rows = _folded(spark, d).withColumn("kept", F.lit(True))
    return gate.ratios(rows, P, gated_input=False).select("clip_id", r("gating_ratio"))


@query(q("SELECT clip_id, bin, len, first FROM stable", "stable"))
def stable_runs(spark, d):
    return features.stable(_runs(spark, d), P).select("clip_id", "bin", "len", "first")


@query(ORACLES["stable_runs"])
def stable_runs_segmented(spark, d):
    return features.stable(segments.runs(_folded(spark, d), P, 50), P).select("clip_id", "bin", "len", "first")


@query(q('SELECT clip_id, raga, dir, frm, "to", cnt FROM dyads', "dyads"))
def transitions_directed(spark, d):
    return _dyads(spark, d)


@query(ORACLES["transitions_directed"])
def transitions_segmented(spark, d):
    return features.dyads(segments.transitions(segments.runs(_folded(spark, d), P, 50), P, size=50))


@query(q("""SELECT clip_id, raga, CASE WHEN bin > prv THEN 'up' ELSE 'down' END AS dir, prv AS frm, bin AS "to", count(*) AS cnt FROM (SELECT *, lag(bin) OVER (PARTITION BY clip_id ORDER BY first) AS prv FROM runs) WHERE len >= 2 AND prv <> bin GROUP BY ALL""", "runs"))
def transitions_variant_b(spark, d):
    return features.dyads(features.transitions(_runs(spark, d), P, "into"))


@query(q("""SELECT clip_id, raga, 'any' AS dir, bin AS frm, nxt AS "to", count(*) AS cnt FROM (SELECT *, lead(bin) OVER (PARTITION BY clip_id ORDER BY pos) AS nxt FROM binned) WHERE nxt IS NOT NULL GROUP BY ALL""", "binned"))
def transitions_variant_c(spark, d):
    return features.frame_transitions(features.binned(_folded(spark, d), P))


@query(q("""SELECT clip_id, raga, 'any' AS dir, bin AS frm, nxt AS "to", count(*) AS cnt FROM (SELECT *, lead(bin) OVER (PARTITION BY clip_id ORDER BY first) AS nxt FROM runs) WHERE len >= 2 AND nxt IS NOT NULL GROUP BY ALL""", "runs"))
def transitions_variant_d(spark, d):
    return features.dyads(features.transitions(_runs(spark, d), P, "out_of"))


@query(q("SELECT clip_id, round(sum(CASE WHEN len >= 2 THEN len ELSE 0 END) / sum(len), 6) AS coverage FROM runs GROUP BY clip_id", "runs"))
def run_coverage(spark, d):
    return features.coverage(_runs(spark, d), P).select("clip_id", r("coverage"))


@query(q('SELECT round(avg(n), 6) AS mean, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS greatest, median(n) AS median, any_value(pairs) AS pairs FROM (SELECT clip_id, sum(cnt) AS n FROM dyads GROUP BY clip_id), (SELECT count(DISTINCT (frm, "to")) AS pairs FROM dyads)', "dyads"))
def transition_summary(spark, d):
    return stats.transition_summary(_dyads(spark, d)).select(r("mean"), "least", "greatest", "median", "pairs")


@query(q("SELECT alpha, round(avg(n / (n + alpha * 144)), 6) AS signal, round(avg(alpha * 144 / (n + alpha * 144)), 6) AS noise FROM (SELECT clip_id, sum(cnt) AS n FROM dyads GROUP BY clip_id), (VALUES (CAST(0.5 AS DOUBLE)), (0.1), (0.01)) a(alpha) GROUP BY alpha", "dyads"))
def sweep_smoothing(spark, d):
    alphas = spark.createDataFrame([(0.5,), (0.1,), (0.01,)], "alpha double")
    return stats.smoothing_share(_dyads(spark, d), alphas, 12).select("alpha", r("signal"), r("noise"))


# --- models and weights ---------------------------------------------------------------


@query(q("SELECT raga, bin, round(mean, 6) AS mean, round(std, 6) AS std, clip_count FROM models", "models"))
def raga_models(spark, d):
    return models.models(_pcd(spark, d), P).select("raga", "bin", r("mean"), r("std"), "clip_count")


def _increments(spark, d):
    """Three runs; each one takes the clips that are there and not yet included."""
    pcd, counts, totals = (sinks.stored(df, "parts") for df in _parts(spark, d))
    path = sinks.scratch(spark, "increments")
    for run in range(3):
        new = pcd.where(F.col("clip_id") % 3 <= run).select("clip_id").distinct()
        if run:
            new = listing.not_included(new, listing.increments(spark, path, ("clips",))["clips"])
        only = lambda df: df.join(new, "clip_id", "left_semi")  # noqa: E731, B023
        sinks.write_increment(moments.increment(only(pcd), only(counts), only(totals)), path, f"2025010{run + 1}_000000")
    return listing.increments(spark, path, moments.PARTS)


@query(ORACLES["raga_models"])
def models_by_increments(spark, d):
    return moments.models(_increments(spark, d), P).select("raga", "bin", r("mean"), r("std"), "clip_count")


@query(q("""SELECT m.raga, m.dir, m.frm, m."to", round(sum(m.v) / any_value(e.n), 6) AS mean, round(sqrt(sum((m.v - a.v) * (m.v - a.v)) / any_value(e.n) + (any_value(e.n) - count(*)) * any_value(a.v * a.v) / any_value(e.n)), 6) AS std
  FROM matrices m JOIN eligible e ON e.raga = m.raga JOIN mean_matrices a ON a.raga = m.raga AND a.dir = m.dir AND a.frm = m.frm AND a."to" = m."to" WHERE EXISTS (SELECT 1 FROM dyads d WHERE d.raga = m.raga AND d.dir = m.dir AND d.frm = m.frm AND d."to" = m."to") GROUP BY m.raga, m.dir, m.frm, m."to" """, "mean_matrices", "dyads"))
def dyad_models_by_increments(spark, d):
    """Means and deviations of the smoothed transition matrices, in the cells that some clip has."""
    return moments.dyad_models(_increments(spark, d), P)[0].select("raga", "dir", "frm", "to", r("mean"), r("std"))


@query(q("SELECT raga, count(DISTINCT clip_id) AS clip_count, 5 - count(DISTINCT clip_id) AS deficit FROM pcd GROUP BY raga HAVING count(DISTINCT clip_id) < 5", "pcd"))
def excluded_ragas(spark, d):
    return models.excluded(models.clip_counts(_pcd(spark, d)), P)


@query(q("SELECT bin, round(weight, 6) AS weight FROM weights", "weights"))
def idf_variance_weights(spark, d):
    return models.weights(models.models(_pcd(spark, d), P), P).select("bin", r("weight"))


@query(q("SELECT bin, round(ln(n / (df + 1)) + 1, 6) AS weight FROM spread", "spread"))
def idf_weights(spark, d):
    return models.weights(models.models(_pcd(spark, d), P), P, "idf").select("bin", r("weight"))


@query(q("SELECT bin, round(w / (sum(w) OVER () + 1e-8) * 12, 6) AS weight FROM (SELECT bin, ln(n / (df_old + 1)) / (sd + 1e-8) AS w FROM spread)", "spread"))
def idf_weights_old(spark, d):
    return models.weights(models.models(_pcd(spark, d), P), P, "idf_old").select("bin", r("weight"))


@query(q('SELECT raga, dir, frm, "to", round(v, 8) AS v FROM mean_matrices', "mean_matrices"))
def dyad_models_dense(spark, d):
    pcd, counts, totals = _parts(spark, d)
    cells, scalars = models.dyad_models(counts, totals, models.clip_counts(pcd), P)
    axis = F.explode(F.sequence(F.lit(0), F.lit(11)))
    grid = scalars.withColumn("frm", axis).withColumn("to", axis)
    return grid.join(cells, ["raga", "dir", "frm", "to"], "left").select("raga", "dir", F.col("frm").cast("long").alias("frm"), F.col("to").cast("long").alias("to"), r(F.coalesce("m", F.lit(0.0)) + P.alpha * F.col("u"), 8).alias("v"))


_CLIPS = "SELECT user_id AS clip_id, CAST(user_id % 5 AS INTEGER) AS raga, CASE WHEN user_id % 7 = 0 THEN 'v1.1' WHEN user_id % 11 = 0 THEN NULL ELSE 'v1.2' END AS feature_version, avg(value) / 100 % 0.3 AS gating_ratio, count(*) AS frames FROM events GROUP BY user_id"


def _clips(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg((F.avg("value") / 100 % 0.3).alias("gating_ratio"), F.count(F.lit(1)).alias("frames"))
    version = F.when(F.col("user_id") % 7 == 0, "v1.1").when(F.col("user_id") % 11 == 0, None).otherwise("v1.2")
    return rows.select(F.col("user_id").alias("clip_id"), (F.col("user_id") % 5).cast("int").alias("raga"), version.alias("feature_version"), "gating_ratio", "frames")


@query(q("SELECT count(*) AS total_files_seen, count(*) FILTER (w) AS skipped_version, count(*) FILTER (NOT w AND gating_ratio < 0.05) AS skipped_gating, count(*) FILTER (w OR gating_ratio < 0.05) AS skipped_files FROM (SELECT *, feature_version IS DISTINCT FROM 'v1.2' AS w FROM c)", c=_CLIPS))
def guard_counters(spark, d):
    return models.guard_counts(_clips(spark, d), P)


@query(q("SELECT clip_id, raga, frames FROM c WHERE feature_version = 'v1.2' AND gating_ratio >= 0.05 AND frames >= 60", c=_CLIPS))
def guarded_clips(spark, d):
    return models.guarded(_clips(spark, d), P, min_frames=60).select("clip_id", "raga", "frames")


@query(q("SELECT raga, round(avg(gating_ratio), 6) AS mean_gating_ratio, round(avg(frames), 6) AS mean_frames FROM c GROUP BY raga", c=_CLIPS))
def class_scalar_means(spark, d):
    return models.class_means(_clips(spark, d), ["gating_ratio", "frames"]).select("raga", r("mean_gating_ratio"), r("mean_frames"))


@query(q("SELECT 'v1.2' AS feature_version, 12 AS bins, total, included, included_ragas FROM (SELECT count(*) AS total FROM c), (SELECT CAST(sum(n) AS BIGINT) AS included, string_agg(CAST(raga AS VARCHAR), ',' ORDER BY CAST(raga AS VARCHAR)) AS included_ragas FROM eligible)", "eligible", c=_CLIPS))
def run_metadata(spark, d):
    meta = models.run_metadata(_pcd(spark, d), models.guard_counts(_clips(spark, d), P), "20250101_000000", "events", P)
    return meta.select("feature_version", "bins", F.col("total_files_seen").alias("total"), F.col("included_clips").alias("included"), F.array_join("included_ragas", ",").alias("included_ragas"))


# --- scorers ----------------------------------------------------------------------------


@query(q("SELECT clip_id, raga, model, round(pcd_sim, 6) AS pcd_sim, round(dyad_sim, 8) AS dyad_sim, round(score, 6) AS score FROM scores", "scores"))
def score_weighted_dot(spark, d):
    return _scores(spark, d).select("clip_id", "raga", "model", r("pcd_sim"), r("dyad_sim", 8), r("score"))


def _simple(method, kind=None):
    def run(spark, d):
        pcd = _pcd(spark, d)
        model = models.models(pcd, P)
        weight = models.weights(model, P, kind) if kind else None
        return scoring.pcd_similarity(pcd, model, P, method, weight).select("clip_id", "raga", "model", r("pcd_sim"))

    return run


def _simple_sql(expr: str, weight: str = "SELECT bin, 1.0 AS weight FROM bins", *extra: str) -> str:
    return q(f"SELECT d.clip_id, d.raga, m.raga AS model, round({expr}, 6) AS pcd_sim FROM dense d JOIN models m USING (bin) JOIN w USING (bin) JOIN c USING (bin) GROUP BY d.clip_id, d.raga, m.raga", "dense", "models", *extra, w=weight, c="SELECT bin, avg(mean) AS centre FROM models GROUP BY bin")


_RENORM = "sum(p * weight * mean * weight) / ((sum(p * weight) + 1e-8) * (sum(mean * weight) + 1e-8))"
_WEIGHT = "SELECT bin, {} AS weight FROM spread"
for _name, _method, _kind, _sql in (
    ("score_dot", "dot", None, _simple_sql("sum(p * mean)")),
    ("score_cosine", "cosine", None, _simple_sql("sum(p * mean) / ((sqrt(sum(p * p)) + 1e-8) * (sqrt(sum(mean * mean)) + 1e-8))")),
    ("score_mean_sub", "mean_sub", None, _simple_sql("sum((p - centre) * (mean - centre))")),
    ("score_idf", "weighted", "idf", _simple_sql(_RENORM, _WEIGHT.format("ln(n / (df + 1)) + 1"), "spread")),
    ("score_whiten", "weighted", "whiten", _simple_sql(_RENORM, _WEIGHT.format("1 / (sd + 1e-8)"), "spread")),
    ("score_idf_old", "weighted", "idf_old", _simple_sql(_RENORM, "SELECT bin, w / (sum(w) OVER () + 1e-8) * 12 AS weight FROM (SELECT bin, ln(n / (df_old + 1)) / (sd + 1e-8) AS w FROM spread)", "spread")),
):
    QUERIES[_name], ORACLES[_name] = _simple(_method, _kind), _sql


@query(_simple_sql("sum(p * weight * mean * weight)", _WEIGHT.format("1 / (sd + 1e-8)"), "spread"))
def score_whiten_raw(spark, d):
    pcd = _pcd(spark, d)
    model = models.models(pcd, P)
    return scoring.pcd_similarity(pcd, model, P, "weighted_raw", models.weights(model, P, "whiten")).select("clip_id", "raga", "model", r("pcd_sim"))


_PAIRS = dict(pairs="SELECT a.model, b.model AS other, sum(a.y * b.y) AS sim FROM model_w a JOIN model_w b USING (bin) WHERE a.model <> b.model GROUP BY a.model, b.model")


@query(q("SELECT clip_id, s.model, round(0.8 * pcd_sim - a.avg_sim + (SELECT avg(avg_sim) FROM h), 6) AS score FROM pcd_sims s JOIN h a ON a.model = s.model", "pcd_sims", **_PAIRS, h="SELECT model, avg(sim) AS avg_sim FROM pairs GROUP BY model"))
def score_hubness(spark, d):
    pcd = _pcd(spark, d)
    model = models.models(pcd, P)
    w = models.weights(model, P)
    scores = scoring.blend(scoring.pcd_similarity(pcd, model, P, "weighted", w), None, P)
    return scoring.centred(scores, scoring.hubness(scoring.model_pairs(model, P, w))).select("clip_id", "model", r("score"))


_NOTES = [("Sa", 0, 0), ("R", 1, 2), ("G", 3, 4), ("M", 5, 6), ("Pa", 7, 7), ("D", 8, 9), ("N", 10, 11)]
_NEEDED = [(2, "Sa"), (2, "Pa"), (2, "R"), (3, "Sa"), (3, "G"), (3, "M"), (4, "Sa"), (4, "D"), (5, "N"), (5, "Pa"), (5, "G")]
_VALUES = lambda rows, cols: f"SELECT * FROM (VALUES {', '.join(str(x) for x in rows)}) v({cols})"
_DOT = "SELECT d.clip_id, d.raga, m.raga AS model, 0.8 * sum(p * mean) AS score FROM dense d JOIN models m USING (bin) GROUP BY ALL"


def _plain_scores(pcd, model):
    return scoring.blend(scoring.pcd_similarity(pcd, model, P, "dot"), None, P)


@query(q("SELECT clip_id, note, round(sum(p), 6) AS energy FROM pcd JOIN notes ON bin BETWEEN lo AND hi GROUP BY clip_id, note", "pcd", notes=_VALUES(_NOTES, "note, lo, hi")))
def note_energy(spark, d):
    return scoring.note_energy(_pcd(spark, d), spark.createDataFrame(_NOTES, "note string, lo int, hi int")).select("clip_id", "note", r("energy"))


@query(q("SELECT s.clip_id, s.model, round(score * (1 - 0.2 * coalesce(a.share, 0)), 6) AS score FROM s LEFT JOIN a ON a.clip_id = s.clip_id AND a.model = s.model", "dense", "models", s=_DOT,
         e="SELECT raga AS model, bin FROM models JOIN (SELECT raga, median(mean) AS med FROM models WHERE mean > 0 GROUP BY raga) USING (raga) WHERE mean > 1.2 * med",
         a="SELECT clip_id, model, avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END) AS share FROM e JOIN dense USING (bin) GROUP BY clip_id, model"))
def score_absent_model(spark, d):
    pcd = _pcd(spark, d)
    model = models.models(pcd, P)
    return scoring.absent_by_model(_plain_scores(pcd, model), pcd, model, 0.2, 1.2, 0.05).select("clip_id", "model", r("score"))


@query(q("SELECT s.clip_id, s.model, round(score * (1 - 0.2 * coalesce(a.share, 0)), 6) AS score FROM s LEFT JOIN a ON a.clip_id = s.clip_id AND a.model = s.model", "dense", "models", s=_DOT, notes=_VALUES(_NOTES, "note, lo, hi"), needed=_VALUES(_NEEDED, "model, note"),
         en="SELECT clip_id, note, sum(p) AS energy FROM dense JOIN notes ON bin BETWEEN lo AND hi GROUP BY clip_id, note",
         a="SELECT clip_id, model, avg(CASE WHEN energy < 0.1 THEN 1.0 ELSE 0.0 END) AS share FROM needed JOIN en USING (note) GROUP BY clip_id, model"))
def score_absent_dictionary(spark, d):
    pcd = _pcd(spark, d)
    model = models.models(pcd, P)
    notes, needed = spark.createDataFrame(_NOTES, "note string, lo int, hi int"), spark.createDataFrame(_NEEDED, "model int, note string")
    return scoring.absent_by_dictionary(_plain_scores(pcd, model), pcd, notes, needed, 0.2, 0.1).select("clip_id", "model", r("score"))


_RATIO = "greatest(0, 1 - abs(t.{0} - m.{0}) / (m.{0} + 1e-8))"


@query(q(f"SELECT s.clip_id, s.model, round(score * (1 + 0.1 * 0.5 * ({_RATIO.format('pa')} + {_RATIO.format('ni')})), 6) AS score FROM s JOIN t ON t.clip_id = s.clip_id JOIN m ON m.model = s.model", "dense", "models", s=_DOT,
         t="SELECT clip_id, sum(CASE WHEN bin BETWEEN 6 AND 8 THEN p ELSE 0 END) AS pa, sum(CASE WHEN bin BETWEEN 10 AND 11 THEN p ELSE 0 END) AS ni FROM dense GROUP BY clip_id",
         m="SELECT raga AS model, sum(CASE WHEN bin BETWEEN 6 AND 8 THEN mean ELSE 0 END) AS pa, sum(CASE WHEN bin BETWEEN 10 AND 11 THEN mean ELSE 0 END) AS ni FROM models GROUP BY raga"))
def score_ratio(spark, d):
    pcd = _pcd(spark, d)
    model = models.models(pcd, P)
    return scoring.ratio_boost(_plain_scores(pcd, model), pcd, model, {"pa": (6, 8), "ni": (10, 11)}, 0.1, P).select("clip_id", "model", r("score"))


@query(q("SELECT s.clip_id, s.model, round(score - 0.05 * e.nats, 6) AS score FROM s JOIN (SELECT clip_id, -sum(p * ln(p + 1e-10)) AS nats FROM pcd GROUP BY clip_id) e USING (clip_id)", "dense", "models", s=_DOT))
def score_genericness(spark, d):
    pcd = _pcd(spark, d)
    return scoring.genericness_penalty(_plain_scores(pcd, models.models(pcd, P)), scoring.entropy(pcd)).select("clip_id", "model", r("score"))


@query(q("SELECT s.clip_id, s.model, round(score - 0.05 * e.nats, 6) AS score FROM s JOIN (SELECT raga AS model, -sum(mean * ln(mean + 1e-10)) AS nats FROM models WHERE mean > 0 GROUP BY raga) e USING (model)", "dense", "models", s=_DOT))
def score_genericness_model(spark, d):
    pcd = _pcd(spark, d)
    model = models.models(pcd, P)
    return scoring.genericness_penalty(_plain_scores(pcd, model), scoring.entropy(model, "raga", "mean"), "model").select("clip_id", "model", r("score"))


@query(_simple_sql("sum(p * weight * mean * weight)", "SELECT bin, w / (sum(w) OVER () + 1e-8) * 12 AS weight FROM (SELECT bin, ln(n / (df_old + 1)) / (sd + 1e-8) AS w FROM spread)", "spread"))
def score_idf_old_raw(spark, d):
    pcd = _pcd(spark, d)
    model = models.models(pcd, P)
    return scoring.pcd_similarity(pcd, model, P, "weighted_raw", models.weights(model, P, "idf_old")).select("clip_id", "raga", "model", r("pcd_sim"))


@query(q("SELECT clip_id, s.model, round(coalesce(pw, 0.8) * pcd_sim + coalesce(dw, 0.2) * dyad_sim, 6) AS score FROM scores s LEFT JOIN (VALUES (3, 0.5, 0.5)) o(model, pw, dw) ON o.model = s.model", "scores"))
def score_override(spark, d):
    base = _scores(spark, d)
    over = spark.createDataFrame([(3, 0.5, 0.5)], "model int, pcd_w double, dyad_w double")
    return scoring.blend(base.select("clip_id", "raga", "model", "pcd_sim"), base.select("clip_id", "model", "dyad_sim"), P, over).select("clip_id", "model", r("score"))


_JS = "sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + m)) ELSE 0 END + CASE WHEN m > 0 THEN m * ln(2 * m / (p + m)) ELSE 0 END) / 2))"
_JS_TABLES = dict(mm="SELECT raga AS model, bin, mean / sum(mean) OVER (PARTITION BY raga) AS m FROM models", js=f"SELECT clip_id, raga, model, {_JS} AS distance FROM dense JOIN mm USING (bin) GROUP BY clip_id, raga, model")


@query(q("SELECT clip_id, model, round(distance, 6) AS distance FROM js", "dense", "models", **_JS_TABLES))
def score_jensen_shannon(spark, d):
    pcd = _pcd(spark, d)
    return scoring.jensen_shannon(pcd, models.models(pcd, P)).select("clip_id", "model", r("distance"))


@query(q(f"SELECT clip_id, CASE WHEN d2 - d1 < 0.01 OR (d2 - d1 < 0.02 AND d3 - d2 < 0.01) THEN '{UNKNOWN}' ELSE best END AS final, round(d2 - d1, 6) AS margin_12, round(d3 - d2, 6) AS margin_23 FROM (SELECT clip_id, max(distance) FILTER (rn = 1) AS d1, max(distance) FILTER (rn = 2) AS d2, max(distance) FILTER (rn = 3) AS d3, max(CAST(model AS VARCHAR)) FILTER (rn = 1) AS best FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY distance, model) AS rn FROM js) GROUP BY clip_id)", "dense", "models", **_JS_TABLES))
def decisions_by_distance(spark, d):
    pcd = _pcd(spark, d)
    return decide.distance_decisions(scoring.jensen_shannon(pcd, models.models(pcd, P)), 0.01, 0.02).select("clip_id", "final", r("margin_12"), r("margin_23"))


_STEPS = """SELECT clip_id, raga, bin AS frm, nxt AS "to", count(*) / sum(count(*)) OVER (PARTITION BY clip_id) AS v FROM (SELECT *, lead(bin) OVER (PARTITION BY clip_id ORDER BY pos) AS nxt FROM binned) WHERE nxt IS NOT NULL GROUP BY clip_id, raga, frm, "to" """
_BLEND = _JS_TABLES | dict(
    st=_STEPS,
    sn="SELECT raga, count(DISTINCT clip_id) AS n FROM st GROUP BY raga",
    smm="""SELECT raga AS model, frm, "to", v / sum(v) OVER (PARTITION BY raga) AS m FROM (SELECT raga, frm, "to", sum(v) / any_value(n) AS v FROM st JOIN sn USING (raga) WHERE raga IN (SELECT raga FROM eligible) GROUP BY raga, frm, "to")""",
    sc="""SELECT clip_id, model, a.range AS frm, b.range AS "to" FROM (SELECT DISTINCT clip_id FROM st), (SELECT DISTINCT model FROM smm), range(12) a, range(12) b""",
    sj="""SELECT clip_id, model, coalesce(st.v, 0) AS p, coalesce(smm.m, 0) AS m FROM sc LEFT JOIN st USING (clip_id, frm, "to") LEFT JOIN smm USING (model, frm, "to")""",
    sd=f"SELECT clip_id, model, {_JS} AS distance FROM sj GROUP BY clip_id, model",
    bl="SELECT js.clip_id, js.model, 0.6 * js.distance + 0.4 * sd.distance AS d1, 0.2 * js.distance + 0.8 * sd.distance AS d2 FROM js JOIN sd USING (clip_id, model)",
)
_SIBLINGS = [(0, 1), (1, 0), (2, 4), (4, 2), (3, 5), (5, 3)]


def _blended(spark, d):
    """Distances with the first and with the escalated weights."""
    folded = _folded(spark, d)
    pcd = features.histogram(folded, P)
    model = models.models(pcd, P)
    steps = features.frame_transitions(features.binned(folded, P))
    mean = models.mean_shares(steps, models.eligible(models.clip_counts(pcd), P), ["frm", "to"])
    dyad = scoring.sparse_jensen_shannon(steps.select("clip_id", "frm", "to", F.col("cnt").cast("double").alias("q")), mean, ["frm", "to"]).withColumnRenamed("distance", "dyad")
    both = scoring.jensen_shannon(pcd, model).join(dyad, ["clip_id", "model"])
    mix = lambda a, b: both.select("clip_id", "model", (a * F.col("distance") + b * F.col("dyad")).alias("distance"))
    return mix(0.6, 0.4), mix(0.2, 0.8)


@query(q("SELECT clip_id, model, round(d1, 6) AS distance FROM bl", "dense", "models", "binned", **_BLEND))
def score_distance_blend(spark, d):
    return _blended(spark, d)[0].select("clip_id", "model", r("distance"))


@query(q(f"""SELECT clip_id, CASE WHEN d2 - d1 < 0.002 OR (d2 - d1 < 0.006 AND d3 - d2 < 0.002) THEN '{UNKNOWN}' ELSE best END AS final, round(d2 - d1, 6) AS margin_12, round(d3 - d2, 6) AS margin_23, escalated
       FROM (SELECT clip_id, max(distance) FILTER (rn = 1) AS d1, max(distance) FILTER (rn = 2) AS d2, max(distance) FILTER (rn = 3) AS d3, max(CAST(model AS VARCHAR)) FILTER (rn = 1) AS best, any_value(escalated) AS escalated
       FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY distance, model) AS rn FROM (SELECT bl.clip_id, bl.model, CASE WHEN o.clip_id IS NULL THEN d1 ELSE d2 END AS distance, o.clip_id IS NOT NULL AS escalated FROM bl LEFT JOIN o ON o.clip_id = bl.clip_id)) GROUP BY clip_id)""", "dense", "models", "binned", **_BLEND,
         rk="SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY d1, model) AS rn FROM bl",
         o="SELECT a.clip_id FROM rk a JOIN rk b ON a.clip_id = b.clip_id AND a.rn = 1 AND b.rn = 2 JOIN (VALUES (0, 1), (1, 0), (2, 4), (4, 2), (3, 5), (5, 3)) s(best, sibling) ON s.best = a.model AND s.sibling = b.model WHERE b.d1 - a.d1 < 0.01"))
def decisions_by_siblings(spark, d):
    first, second = _blended(spark, d)
    siblings = spark.createDataFrame(_SIBLINGS, "best int, sibling int")
    return decide.sibling_escalated(first, second, siblings, 0.01, 0.002, 0.006).select("clip_id", "final", r("margin_12"), r("margin_23"), "escalated")


@query(q('SELECT a.clip_id, b.raga AS model, a.dir, round(sum(a.v * b.v), 8) AS dot FROM matrices a JOIN mean_matrices b ON a.dir = b.dir AND a.frm = b.frm AND a."to" = b."to" GROUP BY ALL', "matrices", "mean_matrices"))
def dyad_similarity_sparse(spark, d):
    pcd, counts, totals = _parts(spark, d)
    cells, scalars = models.dyad_models(counts, totals, models.clip_counts(pcd), P)
    as_map = lambda df, keys, v: df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct((F.col("frm") * 12 + F.col("to")).alias("k"), F.col(v)))).alias("cells"))
    none = lambda kind: F.coalesce("cells", F.create_map().cast(f"map<int,{kind}>"))
    clips = totals.join(as_map(counts, ["clip_id", "dir"], "cnt"), ["clip_id", "dir"], "left").withColumn("cells", none("bigint"))
    classes = scalars.join(as_map(cells, ["raga", "dir"], "m"), ["raga", "dir"], "left").withColumn("cells", none("double")).withColumnRenamed("raga", "model")
    return scoring.sparse_dot(clips, classes, P).select("clip_id", "model", "dir", r("dot", 8))


@query(q("SELECT clip_id, round(-sum(p * ln(p + 1e-10)), 6) AS nats, round(-sum(p * log2(p)), 6) AS bits, count(*) FILTER (p > 0.005) AS active FROM pcd WHERE p > 0 GROUP BY clip_id", "pcd"))
def entropy_by_clip(spark, d):
    return scoring.entropy(_pcd(spark, d)).select("clip_id", r("nats"), r("bits"), "active")


@query(q("SELECT a.raga AS model, b.raga AS other, round(sum(least(a.mean, b.mean)), 6) AS overlap FROM models a JOIN models b USING (bin) WHERE a.raga < b.raga GROUP BY a.raga, b.raga", "models"))
def model_overlap(spark, d):
    return scoring.overlap(models.models(_pcd(spark, d), P)).select("model", "other", r("overlap"))


@query(q("SELECT o.model, round(o.own, 6) AS own, round(p.other, 6) AS other, round(o.own / p.other, 6) AS ratio FROM (SELECT raga AS model, sum(mean * mean) AS own FROM models GROUP BY raga) o JOIN (SELECT a.raga AS model, sum(a.mean * b.mean) / count(DISTINCT b.raga) AS other FROM models a JOIN models b ON a.bin = b.bin AND a.raga <> b.raga GROUP BY a.raga) p USING (model)", "models"))
def discrimination_ratio(spark, d):
    model = models.models(_pcd(spark, d), P)
    own = model.groupBy(F.col("raga").alias("model")).agg(F.sum(F.col("mean") ** 2).alias("own"))
    return stats.discrimination(scoring.model_pairs(model, P), own).select("model", r("own"), r("other"), r("ratio"))


@query(q("SELECT clip_id, round(max(score) - avg(score), 6) AS confidence FROM scores GROUP BY clip_id", "scores"))
def ood_confidence(spark, d):
    return scoring.confidence(_scores(spark, d)).select("clip_id", r("confidence"))


@query(q("SELECT clip_id, " + ", ".join(f'round(max(score) FILTER (model = {k}), 6) AS "{k}"' for k in (2, 3, 4, 5)) + " FROM scores GROUP BY clip_id", "scores"))
def similarity_wide(spark, d):
    return scoring.wide(_scores(spark, d), [2, 3, 4, 5]).select("clip_id", *[r(F.col(str(k))).alias(str(k)) for k in (2, 3, 4, 5)])


# --- decisions ------------------------------------------------------------------------------


@query(q(f"SELECT clip_id, CASE WHEN m < 2e-4 THEN '{UNKNOWN}' ELSE CAST(model AS VARCHAR) END AS final, round(m, 6) AS margin, CASE WHEN m >= 8e-4 THEN 'HIGH' WHEN m >= 2e-4 THEN 'MODERATE' ELSE 'UNKNOWN' END AS confidence_tier FROM (SELECT *, coalesce(score - second, 0) AS m FROM ranked WHERE rank = 1)", "ranked"))
def decisions(spark, d):
    return decide.decisions(_scores(spark, d), None, P).select("clip_id", "final", r("margin"), "confidence_tier")


@query(q(f"SELECT c.clip_id, coalesce(final, '{UNKNOWN}') AS final, coalesce(margin, 0.0) AS margin, coalesce(confidence_tier, 'UNKNOWN') AS confidence_tier FROM (SELECT DISTINCT user_id + k AS clip_id FROM events, (VALUES (0), (100000)) v(k)) c LEFT JOIN (SELECT clip_id, CASE WHEN m < 2e-4 THEN '{UNKNOWN}' ELSE CAST(model AS VARCHAR) END AS final, round(m, 6) AS margin, CASE WHEN m >= 8e-4 THEN 'HIGH' WHEN m >= 2e-4 THEN 'MODERATE' ELSE 'UNKNOWN' END AS confidence_tier FROM (SELECT *, coalesce(score - second, 0) AS m FROM ranked WHERE rank = 1)) USING (clip_id)", "ranked"))
def decisions_of_all_clips(spark, d):
    """Every second clip has no frames at all: no histogram, no scores, so unknown with margin 0."""
    found = _frames(spark, d).select("clip_id").distinct()
    clips = found.unionByName(found.select((F.col("clip_id") + 100000).alias("clip_id")))
    return decide.decisions(_scores(spark, d), clips, P).select("clip_id", "final", r("margin"), "confidence_tier")


@query(q(f"SELECT clip_id, '{UNKNOWN}' AS final, 0.0 AS margin, 'UNKNOWN' AS confidence_tier FROM pcd_sims WHERE model = 3", "pcd_sims"))
def decisions_of_one_model(spark, d):
    return decide.decisions(_scores(spark, d).where("model = 3"), None, P).select("clip_id", "final", r("margin"), "confidence_tier")


@query(q("SELECT clip_id, " + ", ".join(f"coalesce(max(CAST(model AS VARCHAR)) FILTER (rank = {k}), '') AS top{k}, round(coalesce(max(score) FILTER (rank = {k}), 0), 6) AS top{k}_score" for k in (1, 2, 3)) + " FROM ranked GROUP BY clip_id", "ranked"))
def top3_wide(spark, d):
    return decide.top(_scores(spark, d)).select("clip_id", *[c for k in (1, 2, 3) for c in (F.col(f"top{k}"), r(f"top{k}_score"))])


@query(q("SELECT clip_id, model, CAST(rank AS INTEGER) AS rank FROM ranked", "ranked"))
def full_ranking(spark, d):
    return decide.rank(_scores(spark, d)).select("clip_id", "model", "rank")


@query(q("SELECT raga, bin, CAST(rn AS INTEGER) AS rank FROM (SELECT raga, bin, row_number() OVER (PARTITION BY raga ORDER BY round(mean, 9) DESC, bin) AS rn FROM models) WHERE rn <= 10", "models"))
def top_bins(spark, d):
    return decide.top_bins(models.models(_pcd(spark, d), P))


@query(q(f"""SELECT a.clip_id, CASE WHEN a.m >= 8e-4 THEN CAST(a.model AS VARCHAR) WHEN b.m >= 2e-4 THEN CAST(b.model AS VARCHAR) ELSE '{UNKNOWN}' END AS final,
       round(CASE WHEN a.m >= 8e-4 THEN a.m ELSE b.m END, 6) AS margin, CASE WHEN a.m >= 8e-4 THEN 'HIGH' WHEN b.m >= 2e-4 THEN 'ESCALATED' ELSE 'UNKNOWN' END AS confidence_tier
       FROM (SELECT *, coalesce(score - second, 0) AS m FROM ranked WHERE rank = 1) a JOIN (SELECT *, coalesce(s2 - lead(s2) OVER (PARTITION BY clip_id ORDER BY s2 DESC, model), 0) AS m, row_number() OVER (PARTITION BY clip_id ORDER BY s2 DESC, model) AS rn FROM (SELECT *, 0.3 * pcd_sim + 0.7 * dyad_sim AS s2 FROM scores)) b ON a.clip_id = b.clip_id AND b.rn = 1""", "ranked"))
def decisions_escalated(spark, d):
    first = _scores(spark, d)
    second = first.withColumn("score", 0.3 * F.col("pcd_sim") + 0.7 * F.col("dyad_sim"))
    return decide.escalated(first, second, P).select("clip_id", "final", r("margin"), "confidence_tier")


# --- evaluation -------------------------------------------------------------------------------

_VLOO = loo("loo_models", "vectors", 64, 6e-5, 2e-5)


def _vq(body: str) -> str:
    return q(body, "loo_models", **_VLOO)


_TALLY = "count(*) FILTER (outcome = 'c') AS correct, count(*) FILTER (outcome = 'w') AS wrong, count(*) FILTER (outcome = 'u') AS unknown"


@query(_vq("SELECT clip_id, raga, predicted, round(margin, 8) AS margin, tier, outcome FROM lo"))
def loo_outcomes(spark, d):
    return _loo(spark, d).select("clip_id", "raga", "predicted", r("margin", 8), "tier", "outcome")


@query(_vq(f"SELECT raga, total, correct, wrong, unknown, round(correct / total, 6) AS acc_all, round(CASE WHEN correct + wrong > 0 THEN correct / (correct + wrong) ELSE 0 END, 6) AS acc_decided FROM (SELECT raga, count(*) AS total, {_TALLY} FROM lo GROUP BY raga)"))
def loo_per_raga(spark, d):
    return evaluate.per_class(_loo(spark, d)).select("raga", "total", "correct", "wrong", "unknown", r("acc_all"), r("acc_decided"))


@query(_vq(f"SELECT total, correct, wrong, unknown, round(unknown / total, 6) AS unknown_rate, round(correct / total, 6) AS acc_all, round(CASE WHEN correct + wrong > 0 THEN correct / (correct + wrong) ELSE 0 END, 6) AS acc_decided FROM (SELECT count(*) AS total, {_TALLY} FROM lo)"))
def loo_overall(spark, d):
    return evaluate.overall(_loo(spark, d)).select("total", "correct", "wrong", "unknown", r("unknown_rate"), r("acc_all"), r("acc_decided"))


@query(_vq("SELECT raga, CASE WHEN outcome = 'u' THEN 'UNKNOWN' ELSE CAST(predicted AS VARCHAR) END AS said, count(*) AS n FROM lo GROUP BY ALL"))
def loo_confusion(spark, d):
    return evaluate.confusion_long(_loo(spark, d))


@query(_vq("SELECT raga, " + ", ".join(f"""count(*) FILTER (outcome <> 'u' AND predicted = {k}) AS "{k}" """ for k in range(10)) + """, count(*) FILTER (outcome = 'u') AS "UNKNOWN" FROM lo GROUP BY raga"""))
def loo_confusion_wide(spark, d):
    return evaluate.confusion(_loo(spark, d), list(range(10)))


@query(_vq("SELECT predicted AS sink, count(*) AS n FROM lo WHERE outcome = 'w' GROUP BY predicted"))
def loo_sinks(spark, d):
    return evaluate.sinks(_loo(spark, d))


@query(_vq("SELECT predicted AS sink, count(*) AS n FROM lo WHERE outcome = 'w' GROUP BY predicted ORDER BY n DESC, sink LIMIT 3"))
def loo_top_sinks(spark, d):
    return evaluate.sinks(_loo(spark, d), 3)


@query(_vq("SELECT count(*) FILTER (outcome = 'w' AND predicted = 3) AS n FROM lo"))
def loo_named_sink(spark, d):
    return evaluate.named_sink(_loo(spark, d), 3)


@query(_vq("SELECT raga, count(*) FILTER (outcome = 'c' AND tier = 'HIGH') AS high, count(*) FILTER (outcome = 'c' AND tier = 'MODERATE') AS moderate, count(*) FILTER (outcome = 'u') AS unknown, count(*) FILTER (outcome = 'w') AS wrong, round(avg(margin), 8) AS mean_margin FROM lo GROUP BY raga"))
def loo_tiers(spark, d):
    return evaluate.tiers(_loo(spark, d)).select("raga", "high", "moderate", "unknown", "wrong", r("mean_margin", 8))


_FRAME_LOO = loo("loo_naive", "dense", 12, 8e-4, 2e-4)
_LOO_DYADS = {k: v for k, v in _FRAME_LOO.items() if k not in ("lr", "lo")} | with_dyads("ls", "eligible", "dense")


@query(q("SELECT clip_id, raga, model, round(pcd_sim, 6) AS pcd_sim, round(dyad_sim, 8) AS dyad_sim, round(0.8 * pcd_sim + 0.2 * dyad_sim, 6) AS score FROM lf", "loo_naive", "matrices", **_LOO_DYADS))
def loo_scores_with_dyads(spark, d):
    pcd, counts, totals = _parts(spark, d)
    return evaluate.loo_scores(pcd, P, counts, totals).select("clip_id", "raga", "model", r("pcd_sim"), r("dyad_sim", 8), r("score"))


_RENORMED = dict(rm="SELECT fold, truth, model, bin, mean / (sum(mean) OVER (PARTITION BY fold, model) + 1e-8) AS mean FROM loo_models")


@query(q("SELECT clip_id, raga, predicted, tier, outcome FROM lo", "loo_models", **_RENORMED, **loo("rm", "vectors", 64, 6e-5, 2e-5)))
def loo_renormalised(spark, d):
    scores = evaluate.loo_scores(_vectors(spark, d), V, renormalise=True)
    return evaluate.outcomes(scores, V).select("clip_id", "raga", "predicted", "tier", "outcome")


_RESUB = "SELECT clip_id, raga, model AS predicted, coalesce(score - second, 0) AS margin, CASE WHEN coalesce(score - second, 0) < 2e-4 THEN 'u' WHEN model = raga THEN 'c' ELSE 'w' END AS outcome FROM ranked WHERE rank = 1"


@query(q("SELECT clip_id, raga, predicted, outcome FROM rs", "ranked", rs=_RESUB))
def resubstitution(spark, d):
    return evaluate.outcomes(_scores(spark, d), P).select("clip_id", "raga", "predicted", "outcome")


_SWEEP = [(f"w{a}", a, round(1 - a, 1), 8e-4, 2e-4) for a in (1.0, 0.8, 0.7, 0.6)] + [(f"m{m}", 0.8, 0.2, 8e-4, m) for m in (1e-5, 1e-4, 5e-4)]


@query(q(f"""SELECT param, count(*) FILTER (o = 'c') AS correct, count(*) FILTER (o = 'w') AS wrong, count(*) FILTER (o = 'u') AS unknown,
       round(CASE WHEN count(*) FILTER (o <> 'u') > 0 THEN count(*) FILTER (o = 'c') / count(*) FILTER (o <> 'u') ELSE 0 END, 6) AS acc_decided
       FROM (SELECT *, CASE WHEN coalesce(sc - nx, 0) < least_ THEN 'u' WHEN model = raga THEN 'c' ELSE 'w' END AS o FROM
       (SELECT *, lead(sc) OVER (PARTITION BY param, clip_id ORDER BY sc DESC, model) AS nx, row_number() OVER (PARTITION BY param, clip_id ORDER BY sc DESC, model) AS rn FROM (SELECT p.param, p.least_, s.clip_id, s.raga, s.model, p.a * s.pcd_sim + p.b * s.dyad_sim AS sc FROM scores s CROSS JOIN p)) WHERE rn = 1) GROUP BY param""", "scores", p=_VALUES(_SWEEP, "param, a, b, strict, least_")))
def sweep_weights_margins(spark, d):
    params = spark.createDataFrame(_SWEEP, "param string, pcd_w double, dyad_w double, strict double, least double")
    return evaluate.sweep(params, _scores(spark, d)).select("param", "correct", "wrong", "unknown", r("acc_decided"))


_OUT3 = dict(
    el3="SELECT * FROM eligible WHERE raga NOT IN (1, 4)", dense3="SELECT * FROM dense WHERE raga NOT IN (1, 4)",
    naive3="SELECT h.clip_id AS fold, h.raga AS truth, t.raga AS model, t.bin, avg(t.p) AS mean FROM (SELECT DISTINCT clip_id, raga FROM dense3 WHERE raga IN (SELECT raga FROM el3)) h JOIN dense3 t ON t.clip_id <> h.clip_id AND t.raga IN (SELECT raga FROM el3) GROUP BY ALL",
)
_SCENARIOS = (
    _LOO_DYADS | decided("lf", 8e-4, 2e-4, "s1")
    | {"ov": "SELECT clip_id, raga, model, CASE WHEN model = 3 THEN 0.5 ELSE 0.8 END * pcd_sim + CASE WHEN model = 3 THEN 0.5 ELSE 0.2 END * dyad_sim AS score FROM lf"} | decided("ov", 8e-4, 2e-4, "s2")
    | _OUT3 | {k: v for k, v in loo("naive3", "dense3", 12, 8e-4, 2e-4, "x").items() if k not in ("xlr", "xlo")} | with_dyads("xls", "el3", "dense3", "x") | decided("xlf", 8e-4, 2e-4, "s3")
)


@query(q("""SELECT scenario, raga, CASE WHEN outcome = 'u' THEN 'UNKNOWN' ELSE CAST(predicted AS VARCHAR) END AS said, count(*) AS n FROM (SELECT 'all' AS scenario, * FROM s1lo UNION ALL SELECT 'override', * FROM s2lo UNION ALL SELECT 'excluded', * FROM s3lo) GROUP BY ALL""", "loo_naive", "matrices", **_SCENARIOS))
def loo_scenarios(spark, d):
    """Confusion of three runs: all classes, one class with weights of its own, two classes left out."""
    pcd, counts, totals = _parts(spark, d)
    over = spark.createDataFrame([(3, 0.5, 0.5)], "model int, pcd_w double, dyad_w double")
    found = evaluate.scenarios(pcd, counts, totals, over, [1, 4], P)
    said = F.when(F.col("outcome") == "u", "UNKNOWN").otherwise(F.col("predicted").cast("string"))
    return found.groupBy("scenario", "raga", said.alias("said")).agg(F.count(F.lit(1)).alias("n"))


def _tally_sql(rows: str, keys: str) -> str:
    """Tallies by ``keys`` of ``rows`` (``keys, clip_id, raga, model, score``)."""
    return f"""SELECT {keys}, count(*) FILTER (o = 'c') AS correct, count(*) FILTER (o = 'w') AS wrong, count(*) FILTER (o = 'u') AS unknown, round(CASE WHEN count(*) FILTER (o <> 'u') > 0 THEN count(*) FILTER (o = 'c') / count(*) FILTER (o <> 'u') ELSE 0 END, 6) AS acc_decided
       FROM (SELECT *, CASE WHEN coalesce(score - nx, 0) < 2e-4 THEN 'u' WHEN model = raga THEN 'c' ELSE 'w' END AS o FROM (SELECT *, lead(score) OVER (PARTITION BY {keys}, clip_id ORDER BY score DESC, model) AS nx, row_number() OVER (PARTITION BY {keys}, clip_id ORDER BY score DESC, model) AS rn FROM ({rows})) WHERE rn = 1) GROUP BY {keys}"""


# The penalties and thresholds that the sweep of absent notes tries, one after the other.
_PENALTIES = [(x, 0.01) for x in (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50)] + [(0.15, x) for x in (0.005, 0.008, 0.015, 0.020, 0.030)]
# The weights that the sweep of energy ratios tries; 0 is the base line.
_RATIO_WEIGHTS = [(x,) for x in (0.0, 0.05, 0.10, 0.15, 0.20, 0.30, 0.40)]
_DOUBLES = lambda rows: [tuple(f"CAST({x} AS DOUBLE)" for x in row) for row in rows]
_VALUES_D = lambda rows, cols: f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(x) + ')' for x in _DOUBLES(rows))}) v({cols})"


@query(q(_tally_sql("SELECT pp.penalty, pp.least, lf.clip_id, lf.raga, lf.model, lf.score * (1 - pp.penalty * coalesce(ab.share, 0)) AS score FROM lf CROSS JOIN pp LEFT JOIN ab ON ab.least = pp.least AND ab.clip_id = lf.clip_id AND ab.model = lf.model", "penalty, least"), "loo_naive", "matrices", **_LOO_DYADS,
         pp=_VALUES_D(_PENALTIES, "penalty, least"), notes=_VALUES(_NOTES, "note, lo, hi"), needed=_VALUES(_NEEDED, "model, note"),
         en="SELECT clip_id, note, sum(p) AS energy FROM dense JOIN notes ON bin BETWEEN lo AND hi GROUP BY clip_id, note",
         ab="SELECT least, clip_id, model, avg(CASE WHEN energy < least THEN 1.0 ELSE 0.0 END) AS share FROM needed JOIN en USING (note) CROSS JOIN (SELECT DISTINCT least FROM pp) GROUP BY least, clip_id, model"))
def sweep_absent_notes(spark, d):
    pcd, counts, totals = _parts(spark, d)
    notes, needed = spark.createDataFrame(_NOTES, "note string, lo int, hi int"), spark.createDataFrame(_NEEDED, "model int, note string")
    swept = evaluate.sweep_absent(evaluate.loo_scores(pcd, P, counts, totals), pcd, notes, needed, spark.createDataFrame(_PENALTIES, "penalty double, least double"), P)
    return swept.select("penalty", "least", "correct", "wrong", "unknown", r("acc_decided"))


_RATIO_SQL = q(_tally_sql(f"SELECT rw.ratio_w, lf.clip_id, lf.raga, lf.model, lf.score * (1 + rw.ratio_w * 0.5 * ({_RATIO.format('pa')} + {_RATIO.format('ni')})) AS score FROM lf CROSS JOIN rw JOIN t ON t.clip_id = lf.clip_id JOIN m ON m.fold = lf.clip_id AND m.model = lf.model", "ratio_w"), "loo_naive", "matrices", **_LOO_DYADS, rw=_VALUES_D(_RATIO_WEIGHTS, "ratio_w"),
               t="SELECT clip_id, sum(CASE WHEN bin BETWEEN 6 AND 8 THEN p ELSE 0 END) AS pa, sum(CASE WHEN bin BETWEEN 10 AND 11 THEN p ELSE 0 END) AS ni FROM dense GROUP BY clip_id",
               m="SELECT fold, model, sum(CASE WHEN bin BETWEEN 6 AND 8 THEN mean ELSE 0 END) AS pa, sum(CASE WHEN bin BETWEEN 10 AND 11 THEN mean ELSE 0 END) AS ni FROM loo_naive GROUP BY fold, model")


def _ratio_sweep(spark, d):
    pcd, counts, totals = _parts(spark, d)
    scores = evaluate.loo_scores(pcd, P, counts, totals, windows={"pa": (6, 8), "ni": (10, 11)})
    return evaluate.sweep_ratio(scores, ["pa", "ni"], spark.createDataFrame(_RATIO_WEIGHTS, "ratio_w double"), P)


@query(_RATIO_SQL)
def sweep_energy_ratios(spark, d):
    return _ratio_sweep(spark, d).select("ratio_w", "correct", "wrong", "unknown", r("acc_decided"))


@query(f"SELECT max_by(ratio_w, (correct, -wrong, ratio_w)) AS ratio_w, max(correct) AS correct FROM ({_RATIO_SQL})")
def best_ratio_weight(spark, d):
    return evaluate.best_configuration(_ratio_sweep(spark, d), "ratio_w")


@query(f"SELECT n.ratio_w, round(n.acc_decided - b.acc_decided, 6) AS delta, CASE WHEN n.acc_decided > b.acc_decided THEN 'BETTER' WHEN n.acc_decided = b.acc_decided THEN 'SAME' ELSE 'WORSE' END AS verdict FROM ({_RATIO_SQL}) n, ({_RATIO_SQL}) b WHERE b.ratio_w = 0 AND n.ratio_w = 0.4")
def sweep_verdict(spark, d):
    swept = _ratio_sweep(spark, d)
    one = evaluate.verdict(swept.where("ratio_w = 0"), swept.where("ratio_w = 0.4"))
    return one.select(F.lit(0.4).alias("ratio_w"), r("delta"), "verdict")


_BIN_SWEEP = (36, 48, 60, 72, 96, 120)


def _bins_sql(n: int) -> str:
    outcome = "CASE WHEN coalesce(score - second, 0) < 2e-4 THEN 'u' WHEN model = raga THEN 'c' ELSE 'w' END"
    return q(f"SELECT {n} AS n_bins, count(*) FILTER (o = 'c') AS correct, count(*) FILTER (o = 'w') AS wrong, count(*) FILTER (o = 'u') AS unknown, count(*) FILTER (o = 'w' AND model = 3) AS sink, round(CASE WHEN count(*) FILTER (o <> 'u') > 0 THEN count(*) FILTER (o = 'c') / count(*) FILTER (o <> 'u') ELSE 0 END, 6) AS acc_decided FROM (SELECT *, {outcome} AS o FROM ranked WHERE rank = 1)", "ranked", n=n)


@query(" UNION ALL ".join(f"SELECT * FROM ({_bins_sql(n)})" for n in _BIN_SWEEP))
def sweep_bins_scored(spark, d):
    fine = sinks.stored(resolutions.fine_runs(_folded(spark, d)), "fine_runs")
    return evaluate.sweep_bins(resolutions.scores(fine, _BIN_SWEEP, P), P, 3).select("n_bins", "correct", "wrong", "unknown", "sink", r("acc_decided"))


_BINS = (6, 12, 24)


@query(q("SELECT n, clip_id, bin, round(c / sum(c) OVER (PARTITION BY n, clip_id), 6) AS p FROM (SELECT n, clip_id, CAST(least(floor(cents * n / 1200), n - 1) AS INTEGER) AS bin, count(*) AS c FROM folded, (VALUES (6), (12), (24)) b(n) WHERE cents IS NOT NULL GROUP BY ALL)", "folded"))
def sweep_bins(spark, d):
    return resolutions.histograms(resolutions.fine_runs(_folded(spark, d)), _BINS).select(F.col("n_bins").alias("n"), "clip_id", "bin", r("p"))


def _weighted_sql(n: int) -> str:
    body = """SELECT {n} AS n_bins, param, count(*) FILTER (o = 'c') AS correct, count(*) FILTER (o = 'w') AS wrong, count(*) FILTER (o = 'u') AS unknown
       FROM (SELECT *, CASE WHEN coalesce(sc - nx, 0) < least_ THEN 'u' WHEN model = raga THEN 'c' ELSE 'w' END AS o FROM
       (SELECT *, lead(sc) OVER (PARTITION BY param, clip_id ORDER BY sc DESC, model) AS nx, row_number() OVER (PARTITION BY param, clip_id ORDER BY sc DESC, model) AS rn FROM (SELECT p.param, p.least_, s.clip_id, s.raga, s.model, p.a * s.pcd_sim + p.b * s.dyad_sim AS sc FROM scores s CROSS JOIN p)) WHERE rn = 1) GROUP BY param"""
    return q(body.replace("{n}", str(n)), "scores", n=n, p=_VALUES(_SWEEP, "param, a, b, strict, least_"))


@query(" UNION ALL ".join(f"SELECT * FROM ({_weighted_sql(n)})" for n in (12, 24, 36)))
def sweep_bins_weights_margins(spark, d):
    """Resolutions, weights and margins together: one pass over the frames, one over the scores."""
    params = spark.createDataFrame(_SWEEP, "param string, pcd_w double, dyad_w double, strict double, least double")
    fine = sinks.stored(resolutions.fine_runs(_folded(spark, d)), "fine_runs")
    return evaluate.sweep(params, resolutions.scores(fine, (12, 24, 36), P), ("n_bins",)).select("n_bins", "param", "correct", "wrong", "unknown")


@query(q("SELECT clip_id, 'fixed' AS change FROM (SELECT clip_id FROM a WHERE outcome = 'w' EXCEPT SELECT clip_id FROM b WHERE outcome = 'w') UNION ALL SELECT clip_id, 'broken' FROM (SELECT clip_id FROM b WHERE outcome = 'w' EXCEPT SELECT clip_id FROM a WHERE outcome = 'w')", "ranked", a=_RESUB,
         b="SELECT clip_id, CASE WHEN m < 2e-4 THEN 'u' WHEN model = raga THEN 'c' ELSE 'w' END AS outcome FROM (SELECT *, coalesce(s - lead(s) OVER (PARTITION BY clip_id ORDER BY s DESC, model), 0) AS m, row_number() OVER (PARTITION BY clip_id ORDER BY s DESC, model) AS rn FROM (SELECT d.clip_id, d.raga, m.raga AS model, 0.8 * sum(p * mean) AS s FROM dense d JOIN models m USING (bin) GROUP BY ALL)) WHERE rn = 1"))
def fixed_broken_diff(spark, d):
    pcd = _pcd(spark, d)
    return evaluate.fixed_broken(evaluate.outcomes(_scores(spark, d), P), evaluate.outcomes(_plain_scores(pcd, models.models(pcd, P)), P))


@query(q("SELECT clip_id, CASE WHEN coalesce(score - second, 0) < 2e-4 THEN 'UNKNOWN / LOW CONFIDENCE' ELSE CAST(model AS VARCHAR) END AS final, round(coalesce(score - second, 0), 6) AS margin, CASE WHEN coalesce(score - second, 0) >= 8e-4 THEN 'HIGH' WHEN coalesce(score - second, 0) >= 2e-4 THEN 'MODERATE' ELSE 'UNKNOWN' END AS confidence_tier FROM rk WHERE rank = 1", "pcd_sims", rk="SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY 0.8 * pcd_sim DESC, model) AS rank, 0.8 * pcd_sim AS score, lead(0.8 * pcd_sim) OVER (PARTITION BY clip_id ORDER BY 0.8 * pcd_sim DESC, model) AS second FROM pcd_sims"))
def streamed_pieces(spark, d):
    """Frames arrive in five pieces; the query stops after the second and third and is started again."""
    folded = _folded(spark, d).withColumn("n_frames", F.count(F.lit(1)).over(W.partitionBy("clip_id"))).select("clip_id", "raga", "frame_idx", "cents", "n_frames")
    frames = sinks.stored(folded, "frames")
    model = sinks.stored(models.models(_pcd(spark, d), P), "models")
    weight = models.weights(model, P)
    source, out, checkpoint = (sinks.scratch(spark, name) for name in ("pieces", "decided", "progress"))

    def decided(whole):
        sims = scoring.pcd_similarity(pieces.histogram(whole), model, P, "weighted", weight)
        return decide.decisions(scoring.blend(sims, None, P), None, P)

    files = spark.sparkContext.defaultParallelism
    for k in range(5):
        frames.where(F.col("frame_idx") % 5 == k).repartition(files).write.mode("append").parquet(source)
        if k in (1, 2, 4):
            pieces.follow(spark, source, "clip_id long, raga int, frame_idx long, cents double, n_frames long", decided, out, checkpoint, P, files_per_batch=files).awaitTermination()
    rows = spark.read.schema("clip_id long, final string, margin double, confidence_tier string").parquet(out)
    return rows.select("clip_id", "final", r("margin"), "confidence_tier")


# --- scales, n-grams, statistics ------------------------------------------------------------------

_SCALES = [(2, s) for s in (0, 2, 3, 5, 9)] + [(3, s) for s in (0, 2, 4, 6, 7, 9, 11)] + [(5, s) for s in (0, 2, 4, 5, 7, 9, 11)]


@query(q("""SELECT clip_id, raga, round(avg(hit), 6) AS prec_raw, round((avg(hit) - any_value(k) / 12.0) / (1 - any_value(k) / 12.0), 6) AS prec_corrected, round(count(DISTINCT CASE WHEN hit = 1 THEN sem END) / any_value(k), 6) AS recall, round(avg(res), 6) AS residual
       FROM (SELECT s.clip_id, s.raga, floor(s.bin / 2) AS sem, k, CASE WHEN z.semitone IS NULL THEN 0.0 ELSE 1.0 END AS hit, least(s.bin % 2, 2 - s.bin % 2) * 50.0 AS res FROM st s JOIN (SELECT raga, count(*) AS k FROM sc GROUP BY raga) USING (raga) LEFT JOIN sc z ON z.raga = s.raga AND z.semitone = floor(s.bin / 2)) GROUP BY clip_id, raga""", "folded", sc=_VALUES(_SCALES, "raga, semitone"),
         b24="SELECT clip_id, raga, row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS pos, CAST(floor(cents * 24 / 1200) AS INTEGER) AS bin FROM folded WHERE cents IS NOT NULL AND floor(cents * 24 / 1200) BETWEEN 0 AND 23",
         st="SELECT clip_id, raga, bin, count(*) AS len FROM (SELECT *, pos - row_number() OVER (PARTITION BY clip_id, bin ORDER BY pos) AS island FROM b24) GROUP BY clip_id, raga, bin, island HAVING count(*) >= 2"))
def scale_precision(spark, d):
    p = P.but(n_bins=24)
    stable = features.stable(features.runs(features.binned(_folded(spark, d), p)), p)
    scales = spark.createDataFrame(_SCALES, "raga int, semitone int")
    return features.scale_fit(stable, scales, p).select("clip_id", "raga", r("prec_raw"), r("prec_corrected"), r("recall"), r("residual"))


_FIT = "SELECT clip_id, raga, (avg(hit) - any_value(k) / 12.0) / (1 - any_value(k) / 12.0) AS prec, avg(res) AS res FROM (SELECT s.clip_id, s.raga, k, CASE WHEN z.semitone IS NULL THEN 0.0 ELSE 1.0 END AS hit, least(s.bin % 2, 2 - s.bin % 2) * 50.0 AS res FROM st s JOIN (SELECT raga, count(*) AS k FROM sc GROUP BY raga) USING (raga) LEFT JOIN sc z ON z.raga = s.raga AND z.semitone = floor(s.bin / 2)) GROUP BY clip_id, raga"
_STABLE24 = dict(
    sc=_VALUES(_SCALES, "raga, semitone"),
    b24="SELECT clip_id, raga, row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS pos, CAST(floor(cents * 24 / 1200) AS INTEGER) AS bin FROM folded WHERE cents IS NOT NULL AND floor(cents * 24 / 1200) BETWEEN 0 AND 23",
    st="SELECT clip_id, raga, bin, count(*) AS len FROM (SELECT *, pos - row_number() OVER (PARTITION BY clip_id, bin ORDER BY pos) AS island FROM b24) GROUP BY clip_id, raga, bin, island HAVING count(*) >= 2",
    fit=_FIT,
)


def _fits(spark, d):
    p = P.but(n_bins=24)
    stable = features.stable(features.runs(features.binned(_folded(spark, d), p)), p)
    return features.scale_fit(stable, spark.createDataFrame(_SCALES, "raga int, semitone int"), p)


@query(q("SELECT round(min(p), 6) AS least_precision, round(max(r), 6) AS greatest_residual FROM (SELECT raga, avg(prec) AS p, avg(res) AS r FROM fit WHERE raga IN (3, 5) GROUP BY raga)", "folded", **_STABLE24))
def reference_band(spark, d):
    return stats.reference_band(_fits(spark, d), [3, 5]).select(r("least_precision"), r("greatest_residual"))


@query(q("SELECT c.clip_id, round(f.prec, 6) AS prec_corrected, CASE WHEN f.clip_id IS NULL THEN 'SKIPPED' ELSE '' END AS note FROM (SELECT DISTINCT clip_id FROM frames) c LEFT JOIN fit f USING (clip_id)", "folded", **_STABLE24))
def noted_rows(spark, d):
    fits = _fits(spark, d).select("clip_id", r("prec_corrected"))
    clips = _frames(spark, d).select("clip_id").distinct()
    notes = clips.join(fits, "clip_id", "left_anti").withColumn("note", F.lit("SKIPPED"))
    return sinks.noted(clips, fits, notes)


_COLLAPSED = dict(col="SELECT clip_id, symbol, row_number() OVER (PARTITION BY clip_id ORDER BY pos) - 1 AS pos FROM (SELECT clip_id, pos, symbol, lag(symbol) OVER (PARTITION BY clip_id ORDER BY pos) AS prv FROM sym) WHERE prv IS NULL OR prv <> symbol", ng="SELECT clip_id, CAST(sum(CASE WHEN symbol = 'user' AND n1 = 'assistant' AND n2 = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (SELECT *, lead(symbol, 1) OVER w AS n1, lead(symbol, 2) OVER w AS n2 FROM col WINDOW w AS (PARTITION BY clip_id ORDER BY pos)) GROUP BY clip_id")
_SYM = dict(sym="SELECT conv_id AS clip_id, turn AS pos, role AS symbol FROM conversations")


def _ngrams(spark, d):
    return features.ngram_counts(features.collapsed(adapters.symbols(table(spark, d, "conversations"))), ["user", "assistant", "user"])


@query(q("SELECT clip_id, pos, symbol FROM col", **_SYM, col=_COLLAPSED["col"]))
def collapsed_symbols(spark, d):
    return features.collapsed(adapters.symbols(table(spark, d, "conversations")))


@query(q("SELECT clip_id, n FROM ng", **_SYM, **_COLLAPSED))
def ngram_counts(spark, d):
    return _ngrams(spark, d)


@query(q("SELECT round(a, 6) AS target_recall, round(b, 6) AS target_mean, round(c, 6) AS confuser_recall, round(a / c, 6) AS discrimination FROM (SELECT avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END) FILTER (clip_id % 2 = 0) AS a, avg(n) FILTER (clip_id % 2 = 0) AS b, avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END) FILTER (clip_id % 2 = 1) AS c FROM ng)", **_SYM, **_COLLAPSED))
def ngram_recall(spark, d):
    counts = _ngrams(spark, d)
    out = features.ngram_recall(counts.where("clip_id % 2 = 0"), counts.where("clip_id % 2 = 1"))
    return out.select(r("target_recall"), r("target_mean"), r("confuser_recall"), r("discrimination"))


@query("SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d FROM (SELECT count(*) FILTER (event_type = 'click') AS na, avg(value) FILTER (event_type = 'click') AS ma, var_samp(value) FILTER (event_type = 'click') AS va, count(*) FILTER (event_type = 'view') AS nb, avg(value) FILTER (event_type = 'view') AS mb, var_samp(value) FILTER (event_type = 'view') AS vb FROM events)")
def cohens_d(spark, d):
    return stats.cohens_d(table(spark, d, "events"), "value", "event_type", "click", "view").select(r("d"))


def _mixed(x: str) -> str:
    """SQL of the generator's hash of a 32-bit integer."""
    for _ in range(2):
        x = f"((xor({x}, ({x}) >> 16) * 73244475) % 4294967296)"
    return f"xor({x}, ({x}) >> 16)"


#: The hash of seed 0 and of the first block, the start of every value's key.
_FIRST_KEY = 824515495


def _draws(tests: str, body: str) -> str:
    """The permutation tests of ``tests`` (``test, first, x``), drawn value by value in ascending order, before ``body``, which reads ``z`` (``test, p``).

    The same counter-based numbers as the operator's; the distribution function of a draw
    comes from logarithms of factorials.
    """
    chance = "exp(lgamma(n + 1) - lgamma(y + 1) - lgamma(n - y + 1) + lgamma(rest - n + 1) - lgamma(m - y + 1) - lgamma(rest - n - m + y + 1) - lgamma(rest + 1) + lgamma(m + 1) + lgamma(rest - m + 1))"
    upto = f"list_sum(list_transform(range(0, q + 1), lambda y: CASE WHEN y > m OR m - y > rest - n THEN 0 ELSE {chance} END))"
    return f"""
WITH RECURSIVE t AS MATERIALIZED ({tests}
), v AS MATERIALIZED (
  SELECT test, x, n, j, rest, {_mixed(f"(({_FIRST_KEY} + j) % 4294967296)")} AS key
  FROM (SELECT test, x, n, row_number() OVER (PARTITION BY test ORDER BY x) - 1 AS j, CAST(sum(n) OVER (PARTITION BY test ORDER BY x DESC) AS BIGINT) AS rest FROM (SELECT test, x, count(*) AS n FROM t GROUP BY test, x))
), o AS MATERIALIZED (
  SELECT test, count(*) FILTER (first) AS na, count(*) FILTER (NOT first) AS nb, sum(x) AS total, avg(x) FILTER (first) - avg(x) FILTER (NOT first) AS seen FROM t GROUP BY test
), d AS (
  SELECT test, range AS k, CAST(0 AS BIGINT) AS j, na AS m, CAST(0 AS DOUBLE) AS s FROM o, range(50000)
  UNION ALL
  SELECT test, k, j + 1, m - g, s + x * g FROM (
    SELECT test, k, j, m, s, x, CASE WHEN n = 1 THEN CAST(u >= 1 - m / rest AS BIGINT) ELSE len(list_filter(range(0, n), lambda q: {upto} <= u)) END AS g
    FROM (SELECT *, (h + ({_mixed("((h + 1) % 4294967296)")} + 0.5) / 4294967296.0) / 4294967296.0 AS u FROM (SELECT d.*, x, n, rest, {_mixed("((key + k) % 4294967296)")} AS h FROM d JOIN v ON v.test = d.test AND v.j = d.j)))
), z AS (
  SELECT d.test, (count(*) FILTER (abs(s / na - (total - s) / nb) >= abs(seen) - 1e-9 * (1 + abs(seen))) + 1) / 50001.0 AS p FROM d JOIN o ON o.test = d.test WHERE d.j = (SELECT count(*) FROM v WHERE v.test = d.test) GROUP BY d.test
) {body}"""


def _labelled(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")


@query(_draws("SELECT 1 AS test, toxic = 1 AS first, CAST(n_chars AS DOUBLE) AS x FROM labels JOIN documents USING (doc_id)", "SELECT p FROM z"))
def permutation_p(spark, d):
    return stats.permutation_test(_labelled(spark, d), "n_chars", "toxic", 1, 0).select("p")


@query("SELECT round(avg(n_chars) FILTER (toxic = 1) - avg(n_chars) FILTER (toxic = 0), 6) AS observed, count(n_chars) FILTER (toxic = 1) AS n_a, count(n_chars) FILTER (toxic = 0) AS n_b FROM labels JOIN documents USING (doc_id)")
def permutation_observed(spark, d):
    return stats.observed_difference(_labelled(spark, d), "n_chars", "toxic", 1, 0).select(r("observed"), "n_a", "n_b")


_POOL = """SELECT 'once' AS test, quality = 1 AS first, CAST(n_chars AS DOUBLE) AS x FROM labels JOIN documents USING (doc_id) WHERE quality IN (0, 1)
  UNION ALL SELECT 'twice', quality = 1, CAST(n_chars AS DOUBLE) FROM labels JOIN documents USING (doc_id), range(2) r(i) WHERE quality IN (0, 1) AND (quality = 1 OR i = 0)"""


@query(
    _draws(
        _POOL,
        """SELECT z.test, round(p, 9) AS p, round(rm, 6) AS reference_median, round(tm, 6) AS target_median, beats, CASE WHEN p < 0.05 AND ta < ra THEN 'WORSE' WHEN tm >= rm THEN 'NO DEGRADATION' ELSE 'INCONCLUSIVE' END AS verdict
  FROM z JOIN (SELECT test, median(x) FILTER (first) AS rm, median(x) FILTER (NOT first) AS tm, avg(x) FILTER (first) AS ra, avg(x) FILTER (NOT first) AS ta FROM t GROUP BY test) a ON a.test = z.test
  JOIN (SELECT t.test, count(*) FILTER (NOT first AND x > q) AS beats FROM t JOIN (SELECT test, median(x) FILTER (first) AS q FROM t GROUP BY test) b ON b.test = t.test GROUP BY t.test) c ON c.test = z.test""",
    )
)
def separation_verdicts(spark, d):
    """Texts of low quality against those of high quality, these pooled once and (as a class that is listed twice) twice."""
    rows = _labelled(spark, d)
    one = lambda name, references: stats.separation_test(rows, "n_chars", "quality", 0, references).select(F.lit(name).alias("test"), r("p", 9), r("reference_median"), r("target_median"), "beats", "verdict")
    return one("once", [1]).unionByName(one("twice", [1, 1]))


@query(q("SELECT model, note, round(coalesce(sum(mean), 0), 6) AS energy FROM (SELECT DISTINCT n.model, notes.note, lo, hi FROM needed n, notes WHERE NOT EXISTS (SELECT 1 FROM needed x WHERE x.model = n.model AND x.note = notes.note)) z JOIN models ON raga = model AND bin BETWEEN lo AND hi GROUP BY model, note", "models", notes=_VALUES(_NOTES, "note, lo, hi"), needed=_VALUES(_NEEDED, "model, note")))
def notes_outside_the_scale(spark, d):
    notes, needed = spark.createDataFrame(_NOTES, "note string, lo int, hi int"), spark.createDataFrame(_NEEDED, "model int, note string")
    return scoring.absent_energy(models.models(_pcd(spark, d), P), notes, needed).select("model", "note", r("energy"))


@query("SELECT raga, model, clip_id FROM (SELECT o_custkey % 5 AS raga, o_orderkey % 7 AS model, o_orderkey AS clip_id, row_number() OVER (PARTITION BY o_custkey % 5, o_orderkey % 7 ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")
def first_seen_pairs(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("raga"), (F.col("o_orderkey") % 7).alias("model"), F.col("o_orderkey").alias("clip_id"))
    return scoring.first_seen(rows, ["raga", "model"], ["clip_id"])


@query("SELECT round(rm, 6) AS reference_median, round(tm, 6) AS target_median, (SELECT count(*) FROM events WHERE event_type = 'click' AND value > rm) AS beats FROM (SELECT median(value) FILTER (event_type = 'view') AS rm, median(value) FILTER (event_type = 'click') AS tm FROM events)")
def above_reference_median(spark, d):
    return stats.above_median(table(spark, d, "events"), "value", "event_type", "click", "view").select(r("reference_median"), r("target_median"), "beats")


@query(q("SELECT raga, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std, round(min(e), 6) AS least, round(max(e), 6) AS greatest FROM en GROUP BY raga", "dense", en="SELECT clip_id, raga, sum(CASE WHEN bin BETWEEN 6 AND 8 THEN p ELSE 0 END) AS e FROM dense GROUP BY clip_id, raga"))
def window_energy_by_class(spark, d):
    pcd = _pcd(spark, d)
    rows = scoring.window_energies(pcd, "clip_id", {"e": (6, 8)}).join(pcd.select("clip_id", "raga").distinct(), "clip_id")
    return stats.by_class(rows, "e").select("raga", r("mean"), r("std"), r("least"), r("greatest"))


@query(q("SELECT (SELECT count(*) FROM en WHERE raga = 3 AND e >= (SELECT min(e) FROM en WHERE raga = 4)) AS overlapping, (SELECT count(*) FROM en WHERE raga = 3) AS n, round((SELECT avg(e) FROM en WHERE raga = 4) / ((SELECT avg(e) FROM en WHERE raga = 3) + 1e-8), 6) AS mean_ratio", "dense", en="SELECT clip_id, raga, sum(CASE WHEN bin BETWEEN 6 AND 8 THEN p ELSE 0 END) AS e FROM dense GROUP BY clip_id, raga"))
def energy_range_overlap(spark, d):
    pcd = _pcd(spark, d)
    rows = scoring.window_energies(pcd, "clip_id", {"e": (6, 8)}).join(pcd.select("clip_id", "raga").distinct(), "clip_id")
    return stats.range_overlap(rows, "e", "raga", 3, 4).select("overlapping", "n", r("mean_ratio"))


@query(q("SELECT count(*) AS frames, count(*) FILTER (NOT ((a.f0 IS NULL AND b.f0 IS NULL) OR (a.f0 IS NOT NULL AND b.f0 IS NOT NULL AND abs(a.f0 - b.f0) <= 1e-8 + 1e-5 * abs(b.f0)))) AS mismatches, round(max(abs(a.f0 - b.f0)), 6) AS max_diff FROM frames a JOIN (SELECT clip_id, frame_idx, CASE WHEN frame_idx % 50 = 0 THEN f0 + 0.5 ELSE f0 END AS f0 FROM frames) b USING (clip_id, frame_idx)", "frames"))
def cache_validation(spark, d):
    a = _frames(spark, d)
    b = a.withColumn("f0", F.when(F.col("frame_idx") % 50 == 0, F.col("f0") + 0.5).otherwise(F.col("f0")))
    return stats.same_frames(a, b).select("frames", "mismatches", r("max_diff"))


# --- names, duplicates, metadata ----------------------------------------------------------------

_FILES = "SELECT lang AS raga, 'Song' || CAST(doc_id % 40 AS VARCHAR) || (CASE doc_id % 4 WHEN 0 THEN '.vocal' WHEN 1 THEN '.demucs-vocal' WHEN 2 THEN '.vocal-s' ELSE '' END) || '_2025010' || CAST(doc_id % 9 + 1 AS VARCHAR) || '_' || lpad(CAST(doc_id % 1000000 AS VARCHAR), 6, '0') || '.npz' AS fname, n_chars % 100 / 100.0 AS gating FROM documents"
_SONGS = "SELECT *, lower(replace(replace(replace(regexp_replace(fname, '_[^_]*_[^_]*$', ''), '.demucs-vocal', ''), '.vocal-s', ''), '.vocal', '')) AS song, CASE WHEN contains(fname, '.vocal_') OR contains(fname, '.vocal-s_') THEN 'STEM' WHEN contains(fname, '.demucs-vocal_') THEN 'DEMUCS' ELSE 'OTHER' END AS kind FROM f"


def _files(spark, d):
    i = F.col("doc_id")
    suffix = F.when(i % 4 == 0, ".vocal").when(i % 4 == 1, ".demucs-vocal").when(i % 4 == 2, ".vocal-s").otherwise("")
    name = F.concat(F.lit("Song"), (i % 40).cast("string"), suffix, F.lit("_2025010"), (i % 9 + 1).cast("string"), F.lit("_"), F.lpad((i % 1000000).cast("string"), 6, "0"), F.lit(".npz"))
    return table(spark, d, "documents").select(F.col("lang").alias("raga"), name.alias("fname"), (F.col("n_chars") % 100 / 100.0).alias("gating"))


@query(q("SELECT raga, fname, song, kind, row_number() OVER (PARTITION BY raga, song ORDER BY gating + CASE WHEN kind = 'STEM' THEN 0.1 ELSE 0 END DESC, fname) = 1 AS kept FROM s", f=_FILES, s=_SONGS))
def dedup_best(spark, d):
    return quality.best_of_duplicates(_files(spark, d))


@query(q("SELECT raga, song, count(*) AS n FROM s GROUP BY raga, song HAVING count(*) > 1", f=_FILES, s=_SONGS))
def duplicate_groups(spark, d):
    return quality.duplicate_groups(_files(spark, d).withColumn("song", G.song(F.col("fname"))), ["raga", "song"])


@query("SELECT xx AS n, count(*) AS groups FROM (SELECT count(*) AS xx FROM documents GROUP BY text) GROUP BY xx")
def duplicate_texts(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("t")).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("groups"))


@query("SELECT url, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS host, CASE WHEN contains(lower(url), 'ref') THEN 'ref' WHEN contains(lower(url), 'page') THEN 'page' END AS keyword, contains(lower(url), '/fr/') AS is_fr FROM pages")
def url_parts(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("url", G.host(url).alias("host"), G.first_keyword(url, ["ref", "page"]).alias("keyword"), G.has(url, "/FR/").alias("is_fr"))


@query(q("SELECT raga, fname, lower(CASE WHEN ends_with(x, '.demucs-vocal') THEN left(x, len(x) - 13) WHEN ends_with(x, '.vocal-s') THEN left(x, len(x) - 8) WHEN ends_with(x, '.vocal') THEN left(x, len(x) - 6) ELSE x END) AS song FROM (SELECT *, regexp_replace(fname, '_[^_]*_[^_]*$', '') AS x FROM f)", f=_FILES))
def songs_by_trailing_suffix(spark, d):
    return _files(spark, d).select("raga", "fname", G.song_trailing(F.col("fname")).alias("song"))


# Made-up spellings for the normalisation of class names, by the remainder of a key.
_SPELT = ("Tōḍi", " KALYANI", "Bhairavi (slow)", "śaṅkarābharaṇaṁ", "Mohanaṁ", "unknown name", "Harikāmbhōji", "Abhōgi 2")
_KEYS = ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(G.SPELLINGS.items()))


@query(f"""SELECT path, name, coalesce((SELECT min_by(v, o) FROM (VALUES {_KEYS}) t(o, k, v) WHERE contains(lower(trim(name)), k)), (SELECT min_by(v, o) FROM (VALUES {_KEYS}) t(o, k, v) WHERE contains(strip_accents(lower(trim(name))), k)), name) AS raga
       FROM (SELECT p_partkey AS path, CASE p_partkey % 8 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_SPELT))} END AS name FROM part)""")
def normalised_class_names(spark, d):
    name = F.element_at(F.array(*map(F.lit, _SPELT)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("path"), name.alias("name")).withColumn("raga", G.class_name(F.col("name")))


_PATHS = "SELECT p_brand || '/' || p_name || chr(92) || p_type || '.MP3' AS path, p_size FROM part"


@query(f"SELECT path, split_part(replace(path, chr(92), '/'), '/', -1) AS file, split_part(replace(path, chr(92), '/'), '/', -2) AS song, split_part(replace(path, chr(92), '/'), '/', -3) AS concert, contains(lower(path), 'steel') AS is_vocal, regexp_matches(lower(path), 'multitrack|violin|mridangam|ghatam|secondary') AS denied FROM ({_PATHS}) WHERE NOT contains(lower(path), 'copper')")
def path_parts(spark, d):
    path = F.concat("p_brand", F.lit("/"), "p_name", F.lit("\\"), "p_type", F.lit(".MP3"))
    rows = G.without_words(table(spark, d, "part").select(path.alias("path")), "path", ["Copper"])
    part = lambda k: G.path_part(F.col("path"), k)
    return rows.select("path", part(1).alias("file"), part(2).alias("song"), part(3).alias("concert"), G.has(F.col("path"), "Steel").alias("is_vocal"), G.denied(F.col("path")).alias("denied"))


_MEANT = {"éa": "Accented", "eau": "Water", "ent": "Ending", "the": "Article", "oi": "Vowels"}
_MEANT_SQL = ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(_MEANT.items()))


@query(f"""SELECT doc_id, name, coalesce((SELECT min_by(v, o) FROM (VALUES {_MEANT_SQL}) t(o, k, v) WHERE contains(lower(trim(name)), k)), (SELECT min_by(v, o) FROM (VALUES {_MEANT_SQL}) t(o, k, v) WHERE contains(strip_accents(lower(trim(name))), k)), name) AS raga
       FROM (SELECT doc_id, left(text, 25) AS name FROM documents)""")
def class_names_of_documents(spark, d):
    """The first letters of the documents as spellings of classes."""
    names_ = table(spark, d, "documents").select("doc_id", F.left("text", F.lit(25)).alias("name"))
    return names_.withColumn("raga", G.class_name(F.col("name"), _MEANT))


@query("SELECT p_partkey, p_brand || '/' || p_name || '/' || p_type || '.mp3' AS path FROM part WHERE NOT regexp_matches(lower(p_brand || '/' || p_name || '/' || p_type), 'steel|promo|brand#1')")
def allowed_paths(spark, d):
    paths = table(spark, d, "part").select("p_partkey", F.concat(F.concat_ws("/", "p_brand", "p_name", "p_type"), F.lit(".mp3")).alias("path"))
    return paths.where(~G.denied(F.col("path"), ("steel", "promo", "brand#1")))


@query("SELECT user_id AS clip_id, CASE WHEN n = 0 THEN 'NO VOICED FRAMES' WHEN n < 55 THEN 'TOO FEW FRAMES' ELSE 'OK' END AS status, n AS voiced FROM (SELECT user_id, count(*) FILTER (event_type <> 'error') AS n FROM events GROUP BY user_id)")
def clip_status(spark, d):
    """The least number of voiced frames is chosen so that both sides have clips at every size."""
    return tonic.status(_frames(spark, d), P.but(min_voiced=55)).select("clip_id", "status", "voiced")


@query("SELECT user_id AS clip_id, 'run_' || strftime(max(ts), '%Y%m%d_%H%M%S') AS run_id FROM events GROUP BY user_id")
def run_stamps(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("clip_id")).agg(G.run_id(F.max("ts")).alias("run_id"))


@query("SELECT o_orderkey, printf('%.1f%%', o_totalprice / 1000000 * 100) AS share FROM orders")
def percent_texts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", G.percent(F.col("o_totalprice") / 1000000).alias("share"))


@query(q("SELECT clip_id, bin, count(*) AS n FROM (SELECT clip_id, CAST(greatest(0, least(11, floor((r - 600) / 100))) AS INTEGER) AS bin FROM folded WHERE r > -1200 AND r < 2400) GROUP BY ALL", "folded"))
def clipped_bins_of_the_wide_window(spark, d):
    wide = pitch.cents(F.col("f0"), SA)
    rows = _frames(spark, d).where(pitch.wide_window(wide)).select("clip_id", pitch.clipped_bin(wide - 600, 12).alias("bin"))
    return rows.groupBy("clip_id", "bin").agg(F.count(F.lit(1)).alias("n"))


# --- round trips through sinks and sources -------------------------------------------------------------


@query("SELECT user_id AS clip_id, CAST(user_id % 5 AS INTEGER) AS raga, round(avg(value) / 100 % 0.3, 6) AS gating_ratio, count(*) AS frames FROM events WHERE event_type <> 'error' GROUP BY user_id HAVING avg(value) / 100 % 0.3 >= 0.05 AND count(*) >= 55")
def feature_store_round_trip(spark, d):
    rows = table(spark, d, "events").where("event_type <> 'error'").groupBy("user_id").agg((F.avg("value") / 100 % 0.3).alias("gating_ratio"), F.collect_list("value").alias("cents_gated"))
    path = sinks.scratch(spark, "features")
    sinks.write_features(rows.select(F.col("user_id").alias("clip_id"), (F.col("user_id") % 5).cast("int").alias("raga"), "gating_ratio", "cents_gated"), path, P)
    return listing.feature_store(spark, path, P, min_frames=55).select("clip_id", "raga", r("gating_ratio"), F.size("cents_gated").cast("long").alias("frames"))


@query(q("SELECT raga, bin, round(mean, 6) AS mean, clip_count FROM models WHERE raga IN (SELECT raga FROM mean_matrices) AND raga <> 2", "models", "mean_matrices"))
def model_store_round_trip(spark, d):
    """Of a class whose transitions are missing the histogram is left out as well."""
    pcd, counts, totals = _parts(spark, d)
    cells, scalars = models.dyad_models(counts, totals, models.clip_counts(pcd), P)
    path = sinks.scratch(spark, "models")
    sinks.write_models(models.models(pcd, P), cells, scalars.where("raga <> 2"), path, "20250101_000000")
    return listing.model_store(spark, path, "20250101_000000")[0].select("raga", "bin", r("mean"), "clip_count")


@query(_vq(f"SELECT raga, total, correct, wrong, unknown FROM (SELECT raga, count(*) AS total, {_TALLY} FROM lo GROUP BY raga)"))
def csv_round_trip(spark, d):
    path = sinks.scratch(spark, "per-raga")
    sinks.write_csv(evaluate.per_class(_loo(spark, d)), path, ["raga"])
    return spark.read.option("header", True).schema("raga int, total long, correct long, wrong long, unknown long, acc_all double, acc_decided double").csv(path).select("raga", "total", "correct", "wrong", "unknown")


@query(_vq("SELECT unnest(['files: ' || total, 'correct: ' || correct, 'wrong: ' || wrong]) AS value FROM (SELECT count(*) AS total, count(*) FILTER (outcome = 'c') AS correct, count(*) FILTER (outcome = 'w') AS wrong FROM lo)"))
def summary_round_trip(spark, d):
    path = sinks.scratch(spark, "summary")
    sinks.write_summary(evaluate.overall(_loo(spark, d)), path)
    return spark.read.text(path).where("value like 'files:%' or value like 'correct:%' or value like 'wrong:%'")


@query(q("SELECT 'v1.2' AS feature_version, 12 AS bins, total AS total_files_seen, included AS included_clips FROM (SELECT count(*) AS total FROM c), (SELECT CAST(sum(n) AS BIGINT) AS included FROM eligible)", "eligible", c=_CLIPS))
def run_metadata_round_trip(spark, d):
    path = sinks.scratch(spark, "run")
    sinks.write_run(models.run_metadata(_pcd(spark, d), models.guard_counts(_clips(spark, d), P), "20250101_000000", "events", P), path)
    return spark.read.schema("feature_version string, bins int, total_files_seen long, included_clips long").json(path)


@query("SELECT 'concert' || CAST(p_size AS VARCHAR) || '/' || lower(p_name) || '/' || CAST(p_partkey AS VARCHAR) || '.mp3' AS path, 1000 + length(p_name) AS size, lower(p_name) AS song FROM part")
def archived_parts(spark, d):
    """Parts written into zip archives, a file of each, and listed from the archives' directories."""
    part = table(spark, d, "part")
    names = part.select(F.concat_ws("/", F.concat(F.lit("concert"), "p_size"), F.lower("p_name"), F.concat("p_partkey", F.lit(".mp3"))).alias("path"), (F.length("p_name") + 1000).cast("long").alias("size"), F.pmod("p_partkey", F.lit(4)).alias("archive"))
    path = sinks.scratch(spark, "archives")
    archives.write(names, path)
    return listing.archive_entries(archives.listing(spark, path)).select("path", "size", "song")


_ENTRIES = "(SELECT p_partkey AS path, lower(p_name) AS song FROM part) s"
_TITLES = "(SELECT min_by(p_type, p_partkey) AS raga, min(p_partkey) AS ord, lower(split_part(p_name, ' ', 1)) AS title FROM part GROUP BY title) m"


def _titles(spark, d):
    part = table(spark, d, "part")
    meta = part.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("title"), F.col("p_type").alias("raga"), F.col("p_partkey").alias("ord"))
    return part.select(F.col("p_partkey").alias("path"), F.lower("p_name").alias("song")), meta


@query(f"SELECT s.path, min_by(raga, ord) AS raga FROM {_ENTRIES} JOIN {_TITLES} ON contains(s.song, m.title) OR contains(m.title, s.song) GROUP BY s.path")
def metadata_first_match(spark, d):
    return quality.first_match(*_titles(spark, d))


@query(f"SELECT s.path, min_by(raga, ord) AS raga FROM {_ENTRIES} JOIN {_TITLES} ON contains(s.song, m.title) GROUP BY s.path")
def metadata_contained_title(spark, d):
    return quality.first_match(*_titles(spark, d), both_ways=False)


@query("SELECT part, max_by(path, (length(path), path)) AS path FROM (SELECT DISTINCT p_brand AS part FROM part) w JOIN (SELECT p_brand || '/' || p_name || '/' || p_type AS path FROM part) e ON contains(path, part) GROUP BY part")
def metadata_longest_match(spark, d):
    part = table(spark, d, "part")
    return quality.longest_match(part.select(F.col("p_brand").alias("part")).distinct(), part.select(F.concat_ws("/", "p_brand", "p_name", "p_type").alias("path")))


@query("SELECT c_name || '.mp3' AS path FROM customer WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT lower(c_name) AS b FROM customer WHERE c_nationkey < 12) e WHERE contains(e.b, substr(lower(c_name), 1, 20)))")
def not_extracted(spark, d):
    customer = table(spark, d, "customer")
    return quality.not_extracted(customer.select(F.concat("c_name", F.lit(".mp3")).alias("path")), customer.where("c_nationkey < 12").select(F.col("c_name").alias("base")))


@query("SELECT r_name AS raga, CAST(r_regionkey AS BIGINT) AS current, coalesce(vocal, 0) AS vocal, coalesce(mix, 0) AS mix, r_regionkey + coalesce(vocal, 0) + coalesce(mix, 0) AS after, greatest(0, 300 - (r_regionkey + coalesce(vocal, 0) + coalesce(mix, 0))) AS gap FROM region LEFT JOIN (SELECT r_name, count(*) FILTER (c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0) AS vocal, count(*) FILTER (c_custkey % 2 <> 0 AND c_acctbal / 1000 > 1) AS mix FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name) USING (r_name)")
def source_inventory(spark, d):
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    home = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("raga"))
    files = table(spark, d, "customer").join(home, F.col("c_nationkey") == F.col("n_nationkey")).select("raga", (F.col("c_mktsegment") == "BUILDING").alias("is_vocal"), (F.col("c_custkey") % 2 == 0).alias("is_multitrack"), (F.col("c_acctbal") / 1000).alias("size_mb"))
    return quality.inventory(files, region.select(F.col("r_name").alias("raga"), F.col("r_regionkey").cast("long").alias("current")), 300)


@query("SELECT DISTINCT p_type AS raga FROM part WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('econ'), ('Promo Plus')) e(x) WHERE contains(replace(lower(p_type), ' ', ''), lower(x)) OR contains(lower(x), replace(lower(p_type), ' ', '')))")
def new_classes(spark, d):
    return quality.new_classes(table(spark, d, "part").select(F.col("p_type").alias("raga")).distinct(), spark.createDataFrame([("econ",), ("Promo Plus",)], "raga string"))


_LABELS = [("Sa", 0), ("R1", 6), ("R2", 8), ("G2", 12), ("G3", 14), ("M1", 18), ("M2", 21), ("Pa", 30), ("D1", 35), ("D2", 37), ("N2", 42), ("N3", 44)]


@query(q("SELECT bin, min_by(label, (abs(bin * 100.0 - place * 1200.0 / 72), place)) AS label FROM (SELECT DISTINCT bin FROM pcd), lab GROUP BY bin", "pcd", lab=_VALUES(_LABELS, "label, place")))
def nearest_label(spark, d):
    labels = spark.createDataFrame(_LABELS, "label string, at int").withColumn("at", F.col("at") / 6.0)
    return quality.nearest_label(_pcd(spark, d), labels, 12)


@query("SELECT base, max_by(name, stamp) AS name, max(stamp) AS stamp FROM (SELECT 'clip' || CAST(user_id AS VARCHAR) AS base, 'clip' || CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '.npz' AS name, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, event_type FROM events) WHERE event_type = 'click' GROUP BY base")
def latest_cached(spark, d):
    base = F.concat(F.lit("clip"), F.col("user_id").cast("string"))
    events = table(spark, d, "events")
    stamped = F.concat(base, F.lit("_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".npz"))
    return listing.latest_cached(events.select(stamped.alias("name"), F.col("event_type").alias("feature_version")), events.select(base.alias("base")), "click")


@query("SELECT c.c_custkey AS clip_id, round(coalesce(o.v, c.c_acctbal), 6) AS f0, CASE WHEN o.v IS NOT NULL THEN 'cache' ELSE 'live' END AS origin FROM customer c LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey")
def cache_or_compute(spark, d):
    """Only customers without a finished order are computed, and these once."""
    clips = table(spark, d, "customer").select(F.col("c_custkey").alias("clip_id"), "c_acctbal")
    cached = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("clip_id")).agg(F.max("o_totalprice").alias("f0"))
    found = listing.cache_or_compute(clips, cached, lambda rows: rows.select("clip_id", F.col("c_acctbal").alias("f0")), store=sinks.scratch(spark, "computed"))
    return found.select("clip_id", r("f0"), "origin")


_TOPS = ", ".join(f"round(coalesce(max(score) FILTER (rank = {k}), 0), 6) AS top{k}_score" for k in (1, 2, 3))


@query(q(f"SELECT clip_id AS file, raga AS true_raga, CASE WHEN outcome = 'u' THEN 'UNKNOWN' ELSE CAST(predicted AS VARCHAR) END AS predicted_raga, CASE WHEN margin >= 8e-4 THEN 'HIGH' WHEN margin >= 2e-4 THEN 'MODERATE' ELSE 'UNKNOWN' END AS confidence_tier, round(margin, 6) AS margin, top1_score, top2_score, top3_score, CASE outcome WHEN 'c' THEN '+' WHEN 'u' THEN '?' ELSE 'X' END AS correct FROM rs JOIN (SELECT clip_id, {_TOPS} FROM ranked GROUP BY clip_id) USING (clip_id)", "ranked", rs=_RESUB))
def per_file_rows(spark, d):
    scores = _scores(spark, d)
    rows = sinks.per_file(evaluate.outcomes(scores, P), decide.top(scores))
    return rows.select("file", "true_raga", "predicted_raga", "confidence_tier", r("margin"), *[r(f"top{k}_score") for k in (1, 2, 3)], "correct")


@query(q(f"""SELECT clip_id AS file, CASE WHEN max(m) < 2e-4 THEN '{UNKNOWN}' ELSE max(CAST(model AS VARCHAR)) FILTER (rank = 1) END AS predicted_raga, CASE WHEN max(m) >= 8e-4 THEN 'HIGH' WHEN max(m) >= 2e-4 THEN 'MODERATE' ELSE 'UNKNOWN' END AS confidence_tier, round(max(m), 6) AS margin, """ + ", ".join(f"coalesce(max(CAST(model AS VARCHAR)) FILTER (rank = {k}), '') AS top{k}_raga" for k in (1, 2, 3)) + f", {_TOPS} FROM (SELECT *, CASE WHEN rank = 1 THEN coalesce(score - second, 0) END AS m FROM ranked) GROUP BY clip_id", "ranked"))
def unlabelled_rows(spark, d):
    scores = _scores(spark, d)
    rows = sinks.unlabelled(decide.decisions(scores, None, P), decide.top(scores))
    return rows.select("file", "predicted_raga", "confidence_tier", r("margin"), *[c for k in (1, 2, 3) for c in (F.col(f"top{k}_raga"), r(f"top{k}_score"))])


@query("SELECT CAST(o_orderkey AS BIGINT) AS clip, o_totalprice AS seconds FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def slowest_clips(spark, d):
    return stats.slowest(table(spark, d, "orders").select(F.col("o_orderkey").alias("clip"), F.col("o_totalprice").alias("seconds")))


@query(q("SELECT clip_id, pos, round(avg(near) OVER (PARTITION BY clip_id), 6) AS share FROM (SELECT clip_id, pos, CASE WHEN bin < 6 THEN 1.0 ELSE 0.0 END AS near FROM binned)", "binned"))
def lower_half_share(spark, d):
    near = F.when(pitch.semitone(F.col("bin"), 12) < 6, 1.0).otherwise(0.0)
    return features.binned(_folded(spark, d), P).select("clip_id", "pos", r(F.avg(near).over(W.partitionBy("clip_id"))).alias("share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
