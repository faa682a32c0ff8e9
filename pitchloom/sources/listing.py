"""Scans: audio listings, feature stores, model stores, metadata and archives."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchloom.functions import names
from pitchloom.params import Params


def audio_files(spark: SparkSession, root: str, labelled: bool = True, with_content: bool = False) -> DataFrame:
    """``path, file, length`` of the audio files under ``root``, and ``raga`` from the folder if labelled.

    Labelled: ``root/<class>/<file>``; other depths are not looked at. Without
    ``with_content`` no file is read.
    """
    glob = f"{root}/*/*" if labelled else f"{root}/*"
    rows = spark.read.format("binaryFile").load(glob)
    rows = rows.where(names.is_audio(F.col("path")))
    label = [names.path_part(F.col("path"), 2).alias("raga")] if labelled else []
    return rows.select("path", names.path_part(F.col("path"), 1).alias("file"), "length", *label, *(["content"] if with_content else []))


_TRACKERS: dict[str, Callable] = {}


def register_pitch_tracker(name: str, function: Callable) -> None:
    """Make a pitch tracker known: a ``mapInPandas`` function from ``path, content`` to frames.

    Decoding and tracking are outside this package; none is shipped.
    """
    _TRACKERS[name] = function


def track(files: DataFrame, name: str) -> DataFrame:
    """``clip_id, raga, frame_idx, f0, voiced`` of audio files, by a registered tracker."""
    if name not in _TRACKERS:
        raise ValueError(f"no pitch tracker named {name!r} is registered")
    return files.mapInPandas(_TRACKERS[name], "clip_id string, raga string, frame_idx long, f0 double, voiced boolean")


def within_duration(frames: DataFrame, seconds: float = 360.0, rate: float = 22050.0, hop: int = 512) -> DataFrame:
    """Only the frames of the first ``seconds``."""
    return frames.where(F.col("frame_idx") * hop / rate < seconds)


def feature_store(spark: SparkSession, path: str, p: Params = Params(), min_frames: int | None = None) -> DataFrame:
    """Clip records of the current version that are gated enough; the filters reach the scan."""
    rows = spark.read.parquet(path)
    rows = rows.where((F.col("feature_version") == p.feature_version) & (F.col("gating_ratio") >= p.min_gating))
    return rows.where(F.size("cents_gated") >= min_frames) if min_frames else rows


def model_store(spark: SparkSession, path: str, run_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A run's models, cells and scalars; classes that lack either side are left out."""
    one = lambda part: spark.read.parquet(f"{path}/{part}").where(F.col("run_id") == run_id).drop("run_id")
    model, cells, scalars = one("pcd"), one("cells"), one("scalars")
    return model.join(scalars.select("raga").distinct(), "raga", "left_semi"), cells, scalars.join(model.select("raga").distinct(), "raga", "left_semi")


def increments(spark: SparkSession, path: str, parts: tuple[str, ...]) -> dict[str, DataFrame]:
    """The moments of all finished runs under ``path``, by part; a run without ``classes`` was broken off and is left out."""
    one = lambda part: spark.read.parquet(f"{path}/{part}").withColumn("run_id", F.col("run_id").cast("string"))
    done = one("classes").select("run_id").distinct()
    return {part: one(part).join(done, "run_id", "left_semi") for part in parts}


def not_included(clips: DataFrame, included: DataFrame, key: str = "clip_id") -> DataFrame:
    """Clips that no increment holds yet."""
    return clips.join(included.select(key).distinct(), key, "left_anti")


def latest_cached(files: DataFrame, bases: DataFrame, version: str | None = None) -> DataFrame:
    """``base, name, stamp``: of each base's files named ``base_YYYYMMDD_HHMMSS.npz`` the newest of the version.

    The base is cut from the name, so that the two tables meet by key.
    """
    base = F.regexp_extract("name", r"^(.*)_\d{8}_\d{6}\.npz$", 1)
    rows = files.withColumn("base", base).where("base <> ''")
    if version is not None:
        rows = rows.where(F.col("feature_version") == version)
    rows = rows.withColumn("stamp", names.version_stamp(F.col("name"), F.col("base"))).join(bases.select("base").distinct(), "base", "left_semi")
    return rows.groupBy("base").agg(F.max_by("name", F.struct("stamp", "name")).alias("name"), F.max("stamp").alias("stamp"))


def cache_or_compute(clips: DataFrame, cached: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "clip_id", value: str = "f0", store: str | None = None) -> DataFrame:
    """``key, value, origin``: the cached value, or the one that ``compute`` makes.

    ``compute`` is a function from rows of ``clips`` to ``key, value``; it gets only those
    whose key the cache lacks, or holds without a value. With ``store`` its results are
    appended there first and read back, so that they are computed once and are the next
    run's cache (see :func:`computed_before`). A clip that is not computed either has no value.
    """
    held = cached.where(F.col(value).isNotNull()).groupBy(key).agg(F.first(value).alias(value))
    missing = clips.join(held.select(key), key, "left_anti")
    made = compute(missing).select(key, value)
    if store is not None:
        path = f"{store}/part={uuid.uuid4().hex}"
        made.write.mode("errorifexists").parquet(path)
        made = clips.sparkSession.read.schema(made.schema).parquet(path)
    keys = clips.select(key).distinct()
    found = keys.join(held.select(key, value, F.lit("cache").alias("origin")).unionByName(made.select(key, value, F.lit("live").alias("origin"))), key, "left")
    return found.select(key, value, F.coalesce("origin", F.lit("live")).alias("origin"))


def computed_before(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """What earlier runs of :func:`cache_or_compute` computed; nothing if there were none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(store).drop("part") if there else spark.createDataFrame([], schema)


def song_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``path, title, artist, raga, common_name`` of nested JSON files, a row per named class; unreadable files are dropped."""
    schema = "raaga array<struct<name:string,common_name:string>>, title string, album_artists array<struct<name:string>>, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    rows = rows.withColumn("path", F.col("_metadata.file_path")).where("_corrupt is null")
    first = F.try_element_at("album_artists", F.lit(1))["name"]
    return rows.select("path", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(first, F.lit("")).alias("artist"), F.explode("raaga").alias("r")).select("path", "title", "artist", F.col("r.name").alias("raga"), F.coalesce("r.common_name", F.lit("")).alias("common_name"))


def archive_entries(listing: DataFrame, least: int = 1000, extensions=names.AUDIO) -> DataFrame:
    """Entries of an archive's listing (``path, size``) that are audio, no folder, no resource fork and not tiny."""
    file = names.path_part(F.col("path"), 1)
    rows = listing.where(~F.col("path").endswith("/") & ~file.startswith("._") & names.is_audio(F.col("path"), extensions) & (F.col("size") >= least))
    low = F.lower("path")
    return rows.select(
        "path", "size", file.alias("file"), F.lower(names.path_part(F.col("path"), 2)).alias("song"), F.lower(names.path_part(F.col("path"), 3)).alias("concert"),
        F.lower(file).contains("vocal").alias("is_vocal"), low.contains("multitrack").alias("is_multitrack"), F.round(F.col("size") / 1048576, 1).alias("size_mb"),
    )


def newest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each class, by its id."""
    return runs.withColumn("_r", F.row_number().over(W.partitionBy("raga").orderBy(F.desc("run_id")))).where("_r = 1").drop("_r")
