"""Sinks: features, models, run metadata, result tables and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchloom.params import Params


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, ``spark.checkpoint.dir``.

    Where a local session names none, the warehouse holds it; a cluster must name it.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to :func:`scratch` and read back: its plan ends there, and it is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_features(clips: DataFrame, path: str, p: Params = Params()) -> None:
    """Append clip records below ``feature_version`` and ``raga``."""
    clips.withColumn("feature_version", F.lit(p.feature_version)).write.mode("append").partitionBy("feature_version", "raga").parquet(path)


def write_models(model: DataFrame, cells: DataFrame, scalars: DataFrame, path: str, run_id: str) -> None:
    """A new run, beside all others; a run is never written twice."""
    for part, df in (("pcd", model), ("cells", cells), ("scalars", scalars)):
        df.write.mode("errorifexists").parquet(f"{path}/{part}/run_id={run_id}")


def write_increment(parts: dict[str, DataFrame], path: str, run_id: str) -> None:
    """A run's moments (see ``operators.moments``) beside those of earlier runs; ``classes`` comes last and makes the run count."""
    for part in sorted(parts, key=lambda x: x == "classes"):
        parts[part].write.mode("errorifexists").parquet(f"{path}/{part}/run_id={run_id}")


def write_run(metadata: DataFrame, path: str) -> None:
    metadata.write.mode("errorifexists").json(path)


def write_csv(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A headed CSV table; with ``order``, sorted over all its files."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").option("header", True).csv(path)


def per_file(results: DataFrame, tops: DataFrame) -> DataFrame:
    """Result rows of labelled files; rounded only here."""
    said = F.when(F.col("outcome") == "u", "UNKNOWN").otherwise(F.col("predicted").cast("string"))
    rows = results.join(tops, "clip_id", "left")
    digits = lambda c, n: F.round(F.coalesce(c, F.lit(0.0)), n).alias(c if isinstance(c, str) else "x")
    return rows.select(F.col("clip_id").alias("file"), F.col("raga").alias("true_raga"), said.alias("predicted_raga"), F.col("tier").alias("confidence_tier"), digits("margin", 6), *[digits(f"top{k}_score", 6) for k in (1, 2, 3)], symbol(F.col("outcome")).alias("correct"))


def symbol(outcome):
    return F.when(outcome == "c", "+").when(outcome == "u", "?").otherwise("X")


def unlabelled(decided: DataFrame, tops: DataFrame) -> DataFrame:
    """Result rows of unlabelled files, also of those without a decision."""
    rows = decided.join(tops, "clip_id", "left")
    cols = []
    for k in (1, 2, 3):
        cols += [F.coalesce(f"top{k}", F.lit("")).alias(f"top{k}_raga"), F.round(F.coalesce(f"top{k}_score", F.lit(0.0)), 6).alias(f"top{k}_score")]
    return rows.select(F.col("clip_id").alias("file"), F.col("final").alias("predicted_raga"), "confidence_tier", F.round("margin", 6).alias("margin"), *cols)


def noted(clips: DataFrame, metrics: DataFrame, notes: DataFrame) -> DataFrame:
    """Experiment rows for every clip: metrics where there are any, and a note where there are none."""
    return clips.join(metrics, "clip_id", "left").join(notes, "clip_id", "left").withColumn("note", F.coalesce("note", F.lit("")))


def summary(overall: DataFrame) -> DataFrame:
    """One text row on an evaluation."""
    return overall.select(
        F.format_string(
            "files: %d\ncorrect: %d\nwrong: %d\nunknown: %d (%.1f%%)\naccuracy, all: %.1f%%\naccuracy, decided: %.1f%%",
            "total", "correct", "wrong", "unknown", F.col("unknown_rate") * 100, F.col("acc_all") * 100, F.col("acc_decided") * 100,
        ).alias("value")
    )


def write_summary(overall: DataFrame, path: str) -> None:
    summary(overall).coalesce(1).write.mode("overwrite").text(path)


def report(rows: DataFrame, limit: int = 100) -> str:
    """A fixed-width table of the first rows, for a console."""
    shown = rows.limit(limit).collect()
    cells = [rows.columns, *[["" if v is None else str(v) for v in r] for r in shown]]
    width = [max(len(r[k]) for r in cells) for k in range(len(rows.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in cells)
