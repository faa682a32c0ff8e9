"""Duplicates, metadata matching and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchloom.functions import names


#: Least letters of the runs by which texts and what they may contain are brought together.
GRAM = 4


def _runs(text: str, lengths: list[int]) -> Column:
    """The different runs of so many letters in a text, as hashes; length 0 gives one."""
    n = F.length(text)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(F.substring(F.col(text), i, F.lit(k))))).otherwise(F.array().cast("array<long>"))
    return F.array_distinct(F.concat(*[F.array(F.xxhash64(F.lit(""))) if k == 0 else of(k) for k in lengths]))


def _candidates(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """``_t, _p``: pairs of distinct texts (``_text, _t``) and parts (``_part, _p``) that may match.

    The runs of the texts are counted, and each part is sought by that run of its own
    that the fewest texts have. A part with a run that no text has is sought nowhere.
    A run has over half the letters of its part: the greatest power of two, from ``GRAM`` on.
    So many different parts with few different letters do not share their runs.
    """
    n = F.length("_part")
    own = F.when(n < GRAM, n)
    for k in (GRAM << i for i in range(12)):
        own = own.when(n < 2 * k, F.lit(k))
    own = own.otherwise(F.lit(GRAM << 12))
    lengths = sorted(r[0] for r in parts.select(own).distinct().collect())  # no more than GRAM + 13
    if not lengths:
        return texts.select("_t").join(parts.select("_p"), F.lit(False))
    of_texts = texts.select("_t", F.explode(_runs("_text", lengths)).alias("_run"))
    counts = of_texts.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    each = None
    for k in lengths:
        each = F.when(own == k, _runs("_part", [k])) if each is None else each.when(own == k, _runs("_part", [k]))
    of_parts = parts.select("_p", F.explode(each).alias("_run")).join(counts, "_run", "left")
    rarest = of_parts.groupBy("_p").agg(F.min_by("_run", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_run")).alias("_run"), F.min(F.coalesce("_n", F.lit(0))).alias("_n")).where("_n > 0")
    return of_texts.join(rarest.select("_p", "_run"), "_run").select("_t", "_p").distinct()


def containing(texts: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """Rows of ``texts`` with the rows of ``parts`` whose ``part`` their ``text`` contains.

    Both sides meet by key: a part's rarest run, of over half its letters, among the
    texts. What travels with a run is a hash of the text or part; the strings themselves meet only where a run agrees, and are then compared. So titles
    that begin alike, or share all common runs, meet few texts that they are not part of,
    and a long text adds a row for each different run. Null texts and parts match nothing;
    an empty part is contained in every text. The column names of the two sides must differ.
    """
    left = texts.where(F.col(text).isNotNull()).withColumn("_t", F.xxhash64(text))
    right = parts.where(F.col(part).isNotNull()).withColumn("_p", F.xxhash64(part))
    pairs = _candidates(left.select(F.col(text).alias("_text"), "_t").distinct(), right.select(F.col(part).alias("_part"), "_p").distinct())
    found = left.join(pairs, "_t").join(right, "_p")
    return found.where(F.contains(text, part)).drop("_t", "_p")


def duplicate_groups(files: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of files that agree in ``keys``, with more than one member."""
    return files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def best_of_duplicates(files: DataFrame) -> DataFrame:
    """``raga, fname, song, kept``: of a class's files on one song, the best is kept.

    Best is the greatest gating ratio, a stem having 0.1 more; ties go to the first name.
    """
    kind = names.isolation(F.col("fname"))
    score = F.col("gating") + F.when(kind == "STEM", 0.1).otherwise(0.0)
    rows = files.select("raga", "fname", names.song(F.col("fname")).alias("song"), kind.alias("kind"), score.alias("score"))
    order = W.partitionBy("raga", "song").orderBy(F.desc("score"), "fname")
    return rows.withColumn("kept", F.row_number().over(order) == 1).select("raga", "fname", "song", "kind", "kept")


def to_remove(files: DataFrame) -> DataFrame:
    return best_of_duplicates(files).where("not kept").select("raga", "fname")


def first_match(entries: DataFrame, metadata: DataFrame, both_ways: bool = True) -> DataFrame:
    """``path, raga``: the first metadata row (by ``ord``) whose title is part of the entry's song, or the other way.

    Of rows with equal titles only the first can be the first match, so the metadata
    are reduced to one row a title, and the entries to one row a song.
    """
    titles = metadata.groupBy("title").agg(F.min_by("raga", "ord").alias("raga"), F.min("ord").alias("ord"))
    songs = entries.select("song").distinct()
    found = containing(songs, "song", titles, "title")
    if both_ways:
        found = found.unionByName(containing(titles, "title", songs, "song"))
    best = found.groupBy("song").agg(F.min_by("raga", "ord").alias("raga"))
    return entries.select("path", "song").join(best, "song").select("path", "raga")


def longest_match(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """``part, path``: for each wanted part of a path, the longest entry that contains it; ties to the last in order."""
    found = containing(entries.select("path").distinct(), "path", wanted.select("part").distinct(), "part")
    return found.groupBy("part").agg(F.max_by("path", F.struct(F.length("path"), "path")).alias("path"))


def not_extracted(staged: DataFrame, existing: DataFrame, prefix: int = 20) -> DataFrame:
    """Staged files the first ``prefix`` letters of whose name are in no existing name.

    They are sought as keys among all runs of the existing names that have one of their
    lengths: ``prefix + 1`` lengths at most, so that the work is linear in the names.
    """
    base = staged.withColumn("_b", F.substring(F.regexp_replace(F.lower(names.stem(F.col("path"))), r"\.mp3$", ""), 1, prefix))
    seen = existing.select(F.lower("base").alias("_e")).where(F.col("_e").isNotNull()).distinct()
    n = F.length("_e")
    lengths = sorted(r[0] for r in base.select(F.length("_b")).distinct().collect() if r[0] is not None)  # prefix + 1 at most
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col("_e"), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    each = F.concat(F.array().cast("array<string>"), *[of(k) if k else F.array(F.lit("")) for k in lengths])
    return base.join(seen.select(F.explode(F.array_distinct(each)).alias("_b")).distinct().hint("merge"), "_b", "left_anti").drop("_b")


def inventory(files: DataFrame, current: DataFrame, goal: int = 10) -> DataFrame:
    """``raga, current, vocal, mix, after, gap``: what files add to each class, and what it still lacks."""
    by = files.groupBy("raga").agg(F.count_if(F.col("is_vocal") & F.col("is_multitrack")).alias("vocal"), F.count_if(~F.col("is_multitrack") & (F.col("size_mb") > 1)).alias("mix"))
    rows = current.join(by, "raga", "left").na.fill(0, ["vocal", "mix"])
    after = F.col("current") + F.col("vocal") + F.col("mix")
    return rows.select("raga", "current", "vocal", "mix", after.alias("after"), F.greatest(F.lit(0), goal - after).alias("gap"))


def new_classes(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Class names that neither contain an existing one nor are contained in one."""
    simple = found.withColumn("_s", F.replace(F.lower("raga"), F.lit(" "), F.lit("")))
    new, old = simple.select("_s").distinct(), existing.select(F.lower("raga").alias("_o")).distinct()
    met = containing(new, "_s", old, "_o").select("_s").unionByName(containing(old, "_o", new, "_s").select("_s"))
    return simple.join(met.distinct(), "_s", "left_anti").drop("_s")


def nearest_label(bins: DataFrame, labels: DataFrame, n_bins: int) -> DataFrame:
    """``bin, label``: the label whose bin is nearest in cents; ties to the lower label bin."""
    width = 1200.0 / n_bins
    away = F.abs(F.col("bin") * width - F.col("at") * width)
    return bins.select("bin").distinct().join(F.broadcast(labels.select("label", "at"))).groupBy("bin").agg(F.min_by("label", F.struct(away, "at")).alias("label"))
