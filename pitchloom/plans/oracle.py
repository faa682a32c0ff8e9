"""DuckDB fragments for the oracles: an independent, dense formulation of each step.

``q(body, *names)`` puts the named tables, and those they need, in front of a query.
"""

from __future__ import annotations

STABLE, ALPHA, EPS = 2, 0.01, 1e-8


def tables(N: int = 12) -> dict[str, str]:  # noqa: N803
    """The fragments for so many bins."""
    return {
        "frames": "SELECT user_id AS clip_id, CAST(CASE WHEN user_id < 3 THEN 6 WHEN user_id < 6 THEN 7 ELSE user_id % 6 END AS INTEGER) AS raga, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, CASE WHEN event_type <> 'error' THEN value + 80 END AS f0, event_type <> 'error' AS voiced FROM events",
        "folded": "SELECT *, r - 1200 * floor(r / 1200) AS cents FROM (SELECT *, 1200 * log2(f0 / 100.0) AS r FROM frames)",
        "pcd": f"SELECT clip_id, raga, bin, c / sum(c) OVER (PARTITION BY clip_id) AS p FROM (SELECT clip_id, raga, CAST(least(floor(cents * {N} / 1200), {N - 1}) AS INTEGER) AS bin, count(*) AS c FROM folded WHERE cents IS NOT NULL GROUP BY ALL)",
        "binned": f"SELECT clip_id, raga, row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) - 1 AS pos, CAST(floor(cents * {N} / 1200) AS INTEGER) AS bin FROM folded WHERE cents IS NOT NULL AND floor(cents * {N} / 1200) BETWEEN 0 AND {N - 1}",
        "runs": "SELECT clip_id, raga, bin, count(*) AS len, min(pos) AS first FROM (SELECT *, pos - row_number() OVER (PARTITION BY clip_id, bin ORDER BY pos) AS island FROM binned) GROUP BY clip_id, raga, bin, island",
        "stable": f"SELECT *, lead(bin) OVER (PARTITION BY clip_id ORDER BY first) AS nxt FROM runs WHERE len >= {STABLE}",
        "dyads": """SELECT clip_id, raga, CASE WHEN nxt > bin THEN 'up' ELSE 'down' END AS dir, bin AS frm, nxt AS "to", count(*) AS cnt FROM stable WHERE nxt <> bin GROUP BY ALL""",
        "eligible": "SELECT raga, count(DISTINCT clip_id) AS n FROM pcd GROUP BY raga HAVING count(DISTINCT clip_id) >= 5",
        "bins": f"SELECT CAST(range AS INTEGER) AS bin FROM range({N})",
        "dense": "SELECT c.clip_id, c.raga, b.bin, coalesce(pcd.p, 0) AS p FROM (SELECT DISTINCT clip_id, raga FROM pcd) c CROSS JOIN bins b LEFT JOIN pcd ON pcd.clip_id = c.clip_id AND pcd.bin = b.bin",
        "models": "SELECT raga, bin, avg(p) AS mean, stddev_pop(p) AS std, count(*) AS clip_count FROM dense WHERE raga IN (SELECT raga FROM eligible) GROUP BY raga, bin",
        "spread": f"SELECT bin, count(*) AS n, sum(CASE WHEN mean > 1.0 / {N} THEN 1 ELSE 0 END) AS df, sum(CASE WHEN mean > 0.001 THEN 1 ELSE 0 END) AS df_old, stddev_pop(mean) AS sd FROM models GROUP BY bin",
        "weights": f"SELECT bin, w / (sum(w) OVER () + {EPS}) * {N} AS weight FROM (SELECT bin, (ln(n / (df + 1)) + 1) / (sd + {EPS}) AS w FROM spread)",
        "cells": f"""SELECT w.dir, a.range AS frm, b.range AS "to" FROM (VALUES ('up'), ('down')) w(dir), range({N}) a, range({N}) b""",
        "enough": f"SELECT clip_id, raga FROM binned GROUP BY clip_id, raga HAVING count(*) >= {STABLE}",
        "matrices": f"""SELECT c.clip_id, c.raga, x.dir, x.frm, x."to", (coalesce(d.cnt, 0) + {ALPHA}) / (sum(coalesce(d.cnt, 0) + {ALPHA}) OVER (PARTITION BY c.clip_id, x.dir) + {EPS}) AS v FROM enough c CROSS JOIN cells x LEFT JOIN dyads d ON d.clip_id = c.clip_id AND d.dir = x.dir AND d.frm = x.frm AND d."to" = x."to" """,
        "mean_matrices": """SELECT m.raga, m.dir, m.frm, m."to", sum(m.v) / any_value(e.n) AS v FROM matrices m JOIN eligible e ON e.raga = m.raga GROUP BY m.raga, m.dir, m.frm, m."to" """,
        "dyad_sims": """SELECT a.clip_id, b.raga AS model, 0.5 * sum(a.v * b.v) AS dyad_sim FROM matrices a JOIN mean_matrices b ON a.dir = b.dir AND a.frm = b.frm AND a."to" = b."to" GROUP BY a.clip_id, b.raga""",
        "clip_w": f"SELECT clip_id, raga, bin, p * weight / (sum(p * weight) OVER (PARTITION BY clip_id) + {EPS}) AS x FROM dense JOIN weights USING (bin)",
        "model_w": f"SELECT raga AS model, bin, mean * weight / (sum(mean * weight) OVER (PARTITION BY raga) + {EPS}) AS y FROM models JOIN weights USING (bin)",
        "pcd_sims": "SELECT clip_id, raga, model, sum(x * y) AS pcd_sim FROM clip_w JOIN model_w USING (bin) GROUP BY clip_id, raga, model",
        "scores": "SELECT s.clip_id, s.raga, s.model, s.pcd_sim, coalesce(d.dyad_sim, 0) AS dyad_sim, 0.8 * s.pcd_sim + 0.2 * coalesce(d.dyad_sim, 0) AS score FROM pcd_sims s LEFT JOIN dyad_sims d ON d.clip_id = s.clip_id AND d.model = s.model",
        "ranked": "SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, model) AS rank, lead(score) OVER (PARTITION BY clip_id ORDER BY score DESC, model) AS second FROM scores",
        "vectors": "SELECT vec_id AS clip_id, label AS raga, CAST(i - 1 AS INTEGER) AS bin, (e[i] - lo) / tot AS p FROM (SELECT vec_id, label, e, lo, list_sum(list_transform(e, lambda x: x - lo)) AS tot FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, list_min(CAST(embedding AS DOUBLE[])) AS lo FROM embeddings)), range(1, 65) r(i)",
        "v_models": "SELECT raga, bin, avg(p) AS mean, count(*) AS n FROM vectors GROUP BY raga, bin",
        "loo_models": "SELECT h.clip_id AS fold, h.raga AS truth, m.raga AS model, m.bin, CASE WHEN m.raga = h.raga THEN (m.mean * m.n - v.p) / (m.n - 1) ELSE m.mean END AS mean FROM (SELECT DISTINCT clip_id, raga FROM vectors) h JOIN vectors v ON v.clip_id = h.clip_id JOIN v_models m ON m.bin = v.bin WHERE m.raga <> h.raga OR m.n > 1",
        "loo_naive": "SELECT h.clip_id AS fold, h.raga AS truth, t.raga AS model, t.bin, avg(t.p) AS mean FROM (SELECT DISTINCT clip_id, raga FROM dense WHERE raga IN (SELECT raga FROM eligible)) h JOIN dense t ON t.clip_id <> h.clip_id AND t.raga IN (SELECT raga FROM eligible) GROUP BY ALL",
    }


USES: dict[str, tuple[str, ...]] = {
    "folded": ("frames",), "pcd": ("folded",), "binned": ("folded",), "runs": ("binned",), "stable": ("runs",), "dyads": ("stable",), "eligible": ("pcd",), "dense": ("pcd", "bins"), "models": ("dense", "eligible"), "spread": ("models",),
    "weights": ("spread",), "enough": ("binned",), "matrices": ("enough", "cells", "dyads"), "mean_matrices": ("matrices", "eligible"), "dyad_sims": ("matrices", "mean_matrices"), "clip_w": ("dense", "weights"), "model_w": ("models", "weights"),
    "pcd_sims": ("clip_w", "model_w"), "scores": ("pcd_sims", "dyad_sims"), "ranked": ("scores",), "v_models": ("vectors",), "loo_models": ("vectors", "v_models"), "loo_naive": ("dense", "eligible"),
}


def q(body: str, *names: str, n: int = 12, **own: str) -> str:
    """``WITH`` the named tables for ``n`` bins (and ``own`` ones, in order) before ``body``."""
    order: list[str] = []
    made = tables(n)

    def need(name: str) -> None:
        for x in USES.get(name, ()):
            need(x)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    ctes = [f"{x} AS ({made[x]})" for x in order] + [f"{x} AS ({sql})" for x, sql in own.items()]
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body


def loo(models: str, clips: str, n: int, strict: float, least: float, pre: str = "") -> dict[str, str]:
    """Tables (named with ``pre``) that score folds against their own models and weights, PCD term only."""
    return {
        f"{pre}w0": f"SELECT fold, bin, (ln(count(*) / (sum(CASE WHEN mean > 1.0 / {n} THEN 1 ELSE 0 END) + 1)) + 1) / (stddev_pop(mean) + {EPS}) AS w FROM {models} GROUP BY fold, bin",
        f"{pre}w1": f"SELECT fold, bin, w / (sum(w) OVER (PARTITION BY fold) + {EPS}) * {n} AS weight FROM {pre}w0",
        f"{pre}a": f"SELECT fold, c.bin, p * weight / (sum(p * weight) OVER (PARTITION BY fold) + {EPS}) AS x FROM {clips} c JOIN {pre}w1 w1 ON w1.fold = c.clip_id AND w1.bin = c.bin",
        f"{pre}b": f"SELECT m.fold, m.truth, m.model, m.bin, m.mean * weight / (sum(m.mean * weight) OVER (PARTITION BY m.fold, m.model) + {EPS}) AS y FROM {models} m JOIN {pre}w1 w1 ON w1.fold = m.fold AND w1.bin = m.bin",
        f"{pre}ls": f"SELECT b.fold AS clip_id, b.truth AS raga, b.model, 0.8 * sum(x * y) AS score FROM {pre}a a JOIN {pre}b b ON a.fold = b.fold AND a.bin = b.bin GROUP BY ALL",
    } | decided(f"{pre}ls", strict, least, pre)


def decided(scores: str, strict: float, least: float, pre: str = "") -> dict[str, str]:
    """``lr``, ``lo``: ranked scores and the decisions on them."""
    return {
        f"{pre}lr": f"SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, model) AS rank, coalesce(score - lead(score) OVER (PARTITION BY clip_id ORDER BY score DESC, model), 0) AS margin FROM {scores}",
        f"{pre}lo": f"SELECT clip_id, raga, model AS predicted, margin, CASE WHEN margin >= {strict} THEN 'HIGH' WHEN margin >= {least} THEN 'MODERATE' ELSE 'UNKNOWN' END AS tier, CASE WHEN margin < {least} THEN 'u' WHEN model = raga THEN 'c' ELSE 'w' END AS outcome FROM {pre}lr WHERE rank = 1",
    }


def with_dyads(scores: str, eligible: str, clips: str, pre: str = "") -> dict[str, str]:
    """``lm``, ``ld``, ``lf``: mean matrices without the fold's own clip, their similarities, and both terms together."""
    return {
        f"{pre}lm": f"""SELECT h.clip_id AS fold, m.raga AS model, m.dir, m.frm, m."to", sum(m.v) / any_value(e.n - CASE WHEN m.raga = h.raga THEN 1 ELSE 0 END) AS v FROM (SELECT DISTINCT clip_id, raga FROM {clips} WHERE raga IN (SELECT raga FROM {eligible})) h JOIN matrices m ON m.clip_id <> h.clip_id JOIN {eligible} e ON e.raga = m.raga GROUP BY ALL""",
        f"{pre}ld": f"""SELECT a.clip_id, b.model, 0.5 * sum(a.v * b.v) AS dyad_sim FROM matrices a JOIN {pre}lm b ON a.clip_id = b.fold AND a.dir = b.dir AND a.frm = b.frm AND a."to" = b."to" GROUP BY ALL""",
        f"{pre}lf": f"SELECT *, 0.8 * pcd_sim + 0.2 * dyad_sim AS score FROM (SELECT s.clip_id, s.raga, s.model, s.score / 0.8 AS pcd_sim, coalesce(d.dyad_sim, 0) AS dyad_sim FROM {scores} s LEFT JOIN {pre}ld d ON d.clip_id = s.clip_id AND d.model = s.model)",
    }
