"""Group comparisons and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.operators import selection
from pitchloom.shipping import known_to_workers


def cohens_d(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """One row ``d``: difference of means over the pooled sample deviation; null with fewer than two values in a group."""
    x = lambda g: F.when(F.col(group) == g, F.col(value))
    one = df.agg(*[f(x(g)).alias(f"{n}{k}") for k, g in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    return one.select(F.when((F.col("na") >= 2) & (F.col("nb") >= 2) & (pooled > 0), (F.col("ma") - F.col("mb")) / pooled).alias("d"))


#: Distinct values that a block of the permutation test holds, and shuffles that are drawn at once.
PER_BLOCK, SHARE = 1 << 16, 1000
#: Probabilities that a draw makes at once, and places whose random numbers are made at once.
TABLE, PLACES = 1 << 20, 32
#: Marked ones, and their greatest mean drawn, that are counted from none on.
MARKED, MEAN = 512, 32


def uniforms(seed: int, block: int, place, shuffles):
    """Numbers in (0, 1) for an array of shuffles, by a counter: a hash of seed, block, place and shuffle. Several places give a row each.

    Each word is an unsigned 32-bit integer ``x``, mixed twice by
    ``(x ^ x >> 16) * 73244475 mod 2^32`` and once by ``x ^ x >> 16``. No state: any task,
    and SQL, gives the same number for the same counter.
    """
    import numpy as np

    def mixed(x):
        for _ in range(2):
            x = (x ^ x >> 16) * 73244475 & 0xFFFFFFFF
        return x ^ x >> 16

    def words(x):  # the same for unsigned 32-bit numbers, which wrap by themselves
        for _ in range(2):
            x = (x ^ x >> np.uint32(16)) * np.uint32(73244475)
        return x ^ x >> np.uint32(16)

    start = 0
    for part in (seed, block):
        start = mixed(start + int(part) & 0xFFFFFFFF)
    keys = np.array([mixed(start + int(one) & 0xFFFFFFFF) for one in np.ravel(place)], np.uint32).reshape(*np.shape(place), 1)
    first = words(shuffles.astype(np.uint32) + keys)
    second = words(first + np.uint32(1))
    return (first + (second + 0.5) / 2.0**32) / 2.0**32


def hypergeometric(total: int, marked: int, drawn, u):
    """How many of ``marked`` among ``total`` are in ``drawn`` ones: the least number whose distribution function exceeds ``u``.

    ``drawn`` and ``u`` are arrays. The probabilities come from the ratios of neighbours,
    within nine deviations of the mean and some more, for all drawn at once (``TABLE``
    probabilities at most). A single marked one is a comparison. Where few are drawn of
    few marked ones (``MEAN``, ``MARKED``), the probability of none is a product, and the
    sum goes no further than the greatest number found.
    """
    import numpy as np

    if not marked or not len(drawn):
        return np.zeros(len(drawn), np.int64)
    if marked == 1:
        return (u >= 1 - drawn / total).astype(np.int64)
    most = int(drawn.max())
    if marked <= MARKED and marked * most <= MEAN * total and most <= total - marked:
        return _from_none(total, marked, drawn, u)
    mean = marked * (drawn / total)
    reach = 9 * np.sqrt(mean * (1 - drawn / total) * ((total - marked) / max(1, total - 1))) + 14
    lo = np.maximum(np.maximum(0, drawn - (total - marked)), (mean - reach).astype(np.int64))
    hi = np.minimum(np.minimum(marked, drawn), (mean + reach).astype(np.int64) + 1)
    width = int((hi - lo).max()) + 1
    x, out, step = np.arange(width - 1, dtype=np.float64)[:, None], np.empty(len(drawn), np.int64), max(1, TABLE // width)
    for first in range(0, len(drawn), step):
        own = slice(first, first + step)
        low, m = lo[own].astype(np.float64), drawn[own]
        # The product is 0 from the last possible number on, as one factor is.
        below = np.ones((width, len(m)))
        np.divide((marked - low - x) * (m - low - x), (low + 1 + x) * (total - marked - m + low + 1 + x), out=below[1:])
        for k in range(1, width):  # row by row, which is faster than along the other axis
            below[k] *= below[k - 1]
        for k in range(1, width):
            below[k] += below[k - 1]
        out[own] = lo[own] + np.minimum((below <= u[own] * below[-1]).sum(axis=0), hi[own] - lo[own])
    return out


def _from_none(total: int, marked: int, drawn, u):
    """:func:`hypergeometric` where none of the marked ones may be drawn: probabilities are summed from 0 on, until none of ``u`` is left."""
    import numpy as np

    out, m, rest = np.zeros(len(drawn), np.int64), drawn.astype(np.float64), (total - marked + 1) - drawn.astype(np.float64)
    each = np.arange(marked, dtype=np.float64)[:, None]
    chance = np.multiply.reduce(((total - m) - each) / (total - each), axis=0)
    below = chance.copy()
    for k in range(marked):
        on = below <= u
        if not on.any():
            break
        out += on
        chance *= (m - k) * ((marked - k) / (k + 1)) / (rest + k)
        below += chance
    return np.minimum(out, drawn)


def permutation_test(df: DataFrame, value: str, group: str, a, b, iterations: int = 50_000, seed: int = 0, per_block: int = PER_BLOCK) -> DataFrame:
    """One row ``p, observed, n_a, n_b``: share of shuffles whose difference of means is at least the observed one, two-sided.

    Values are pre-aggregated to counts, so that a value is one entry however often it
    occurs, and dealt into blocks of about ``per_block`` distinct ones by a hash. A shuffle
    draws ``n_a`` of all: how many of each block, then in a block how many of each value,
    in ascending order; every draw is hypergeometric, from the numbers that remain. Its
    random number depends on seed, block, value's place and shuffle only
    (:func:`uniforms`). A task holds the values of one block and ``SHARE`` shuffles. What
    reaches the driver is one row per block. Without a value in either group ``p`` is null;
    null and NaN values are left out.
    """
    import numpy as np

    spark = df.sparkSession
    known_to_workers(spark)
    x = F.col(value).cast("double")
    rows = df.where(F.col(group).isin(a, b) & x.isNotNull() & ~F.isnan(x)).groupBy(x.alias("x")).agg(F.count_if(F.col(group) == a).alias("a"), F.count(F.lit(1)).alias("n"))
    blocks = max(1, -(-rows.count() // per_block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int"))
    told = {r["block"]: r for r in rows.groupBy("block").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum(F.col("x") * F.col("a")).alias("sa"), F.sum(F.col("x") * F.col("n")).alias("s")).collect()}
    names = sorted(told)
    sizes = [told[k]["n"] for k in names]
    na, nb = sum(told[k]["a"] for k in names), sum(told[k]["n"] - told[k]["a"] for k in names)
    if not na or not nb:
        return spark.createDataFrame([(None, None, na, nb)], "p double, observed double, n_a long, n_b long")
    total = sum(told[k]["s"] for k in names)
    first = sum(told[k]["sa"] for k in names)
    seen = first / na - (total - first) / nb

    def of_blocks(batches):
        """``block, share, m``: how many each shuffle of a share draws of a block."""
        import pyarrow as pa

        for batch in batches:
            for share in batch.column(0).to_pylist():
                k = np.arange(share * SHARE, min(iterations, (share + 1) * SHARE))
                rest, left = sum(sizes), np.full(len(k), na, np.int64)
                for place, (block, size) in enumerate(zip(names, sizes)):
                    m = left if place == len(names) - 1 else hypergeometric(rest, size, left, uniforms(seed, 0, place, k))
                    rest, left = rest - size, left - m
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([share]), pa.array([m.tobytes()], pa.binary())], ["block", "share", "m"])

    def of_values(batches):
        """``k, s``: the sum of what a shuffle draws of a block."""
        import pyarrow as pa

        for batch in batches:
            for block, share, m, held in zip(*(batch.column(c) for c in range(4))):
                xs, ns = (held.values.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                k, left = np.arange(share.as_py() * SHARE, min(iterations, (share.as_py() + 1) * SHARE)), np.frombuffer(m.as_buffer(), np.int64)
                rest, s = int(ns.sum()), np.zeros(len(k))
                for place, (x, n) in enumerate(zip(xs.tolist(), ns.tolist())):
                    if place % PLACES == 0:
                        us = uniforms(seed, block.as_py() + 1, range(place, min(len(xs), place + PLACES)), k)
                    got = hypergeometric(rest, n, left, us[place % PLACES])
                    s += x * got
                    rest, left = rest - n, left - got
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(s)], ["k", "s"])

    shares = -(-iterations // SHARE)
    drawn = spark.range(0, shares, 1, shares).mapInArrow(of_blocks, "block int, share long, m binary")
    held = rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("x", "n"))).alias("held"))
    # A single block is bounded; several are dealt over the tasks.
    both = drawn.join(F.broadcast(held) if blocks == 1 else held, "block").select("block", "share", "m", "held")
    parts = both.mapInArrow(of_values, "k long, s double").groupBy("k").agg(F.sum("s").alias("s"))
    apart = F.abs(F.col("s") / na - (F.lit(total) - F.col("s")) / nb)
    hits = F.count_if(apart >= abs(seen) - 1e-9 * (1 + abs(seen)))
    return parts.agg(((hits + 1) / F.lit(float(iterations + 1))).alias("p")).select("p", F.lit(seen).alias("observed"), F.lit(na).cast("long").alias("n_a"), F.lit(nb).cast("long").alias("n_b"))


def observed_difference(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """One row ``observed, n_a, n_b``: the difference of means that :func:`permutation_test` judges."""
    x = lambda g: F.when((F.col(group) == g) & ~F.isnan(F.col(value).cast("double")), F.col(value))
    return df.agg((F.avg(x(a)) - F.avg(x(b))).alias("observed"), F.count(x(a)).alias("n_a"), F.count(x(b)).alias("n_b"))


def separation_test(df: DataFrame, value: str, group: str, target, references: list, **test) -> DataFrame:
    """One row: a target class against its pooled references, with the verdict.

    The references are pooled with all their rows, a class that is listed twice with twice
    its rows. ``p``: permutation test of the means; ``d``: their distance in deviations;
    ``reference_median, target_median, beats``; ``verdict``.
    """
    pooled = df.where(F.col(group) == target).select(F.lit(1).alias("side"), F.col(value).alias("x"))
    for one in references:
        pooled = pooled.unionByName(df.where(F.col(group) == one).select(F.lit(0).alias("side"), F.col(value).alias("x")))
    p = permutation_test(pooled, "x", "side", 0, 1, **test).select("p")
    means = pooled.agg(F.avg(F.when(F.col("side") == 1, F.col("x"))).alias("target_mean"), F.avg(F.when(F.col("side") == 0, F.col("x"))).alias("reference_mean"))
    one = above_median(pooled, "x", "side", 1, 0).crossJoin(means).crossJoin(p).crossJoin(cohens_d(pooled, "x", "side", 0, 1))  # one row each
    verdict = separation_verdict(F.col("p"), F.col("target_mean"), F.col("reference_mean"), F.col("target_median"), F.col("reference_median"))
    return one.select("p", "d", "reference_median", "target_median", "beats", verdict.alias("verdict"))


def above_median(df: DataFrame, value: str, group: str, target, reference) -> DataFrame:
    """One row: the reference's median, the target's, and how many targets exceed the former.

    Medians are exact; see :func:`~pitchloom.operators.selection.medians`.
    """
    found = selection.medians(df, value, group, [target, reference])
    beats = F.count_if((F.col(group) == target) & (F.col(value) > F.lit(found[reference])))
    return df.agg(beats.alias("beats")).select(F.lit(found[reference]).cast("double").alias("reference_median"), F.lit(found[target]).cast("double").alias("target_median"), "beats")


def separation_verdict(p_value, target_mean, reference_mean, target_median, reference_median):
    """A column: whether a target is worse, as good, or not told apart from the references."""
    return F.when((p_value < 0.05) & (target_mean < reference_mean), "WORSE").when(target_median >= reference_median, "NO DEGRADATION").otherwise("INCONCLUSIVE")


def by_class(df: DataFrame, value: str, group: str = "raga") -> DataFrame:
    """Mean, population deviation, least and greatest by class."""
    return df.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def range_overlap(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """One row: how many of ``a`` reach the least of ``b``, and the ratio of their means."""
    x = lambda g: F.when(F.col(group) == g, F.col(value))
    one = df.agg(F.min(x(b)).alias("least_b"), F.avg(x(a)).alias("ma"), F.avg(x(b)).alias("mb"), F.count(x(a)).alias("n"))
    count = df.where(F.col(group) == a).crossJoin(F.broadcast(one)).agg(F.count_if(F.col(value) >= F.col("least_b")).alias("overlapping"))
    return one.crossJoin(count).select("overlapping", "n", (F.col("mb") / (F.col("ma") + 1e-8)).alias("mean_ratio"))


def transition_summary(counts: DataFrame) -> DataFrame:
    """One row over clips: mean, least, greatest and median number of transitions, and how many different pairs.

    The median is exact; the clips' sums are kept while it is sought.
    """
    per = counts.groupBy("clip_id").agg(F.sum("cnt").alias("n")).persist()
    try:
        median = selection.medians(per, "n")[None]
    finally:
        per.unpersist()
    pairs = counts.agg(F.count_distinct(F.struct("frm", "to")).alias("pairs"))
    return per.agg(F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("greatest"), F.lit(median).cast("double").alias("median")).crossJoin(pairs)  # one row each


def smoothing_share(counts: DataFrame, alphas: DataFrame, n_bins: int) -> DataFrame:
    """``alpha, signal, noise``: mean shares of a matrix's mass that counts and smoothing have."""
    per = counts.groupBy("clip_id").agg(F.sum("cnt").alias("n"))
    noise = F.col("alpha") * n_bins**2
    return per.join(F.broadcast(alphas)).groupBy("alpha").agg(F.avg(F.col("n") / (F.col("n") + noise)).alias("signal"), F.avg(noise / (F.col("n") + noise)).alias("noise"))


def discrimination(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """``model, ratio``: a class's similarity with itself over its mean similarity with others."""
    others = pairs.groupBy("model").agg(F.avg("sim").alias("other"))
    return own.join(others, "model").select("model", "own", "other", (F.col("own") / F.when(F.col("other") != 0, F.col("other"))).alias("ratio"))


def same_frames(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """One row: frames compared, mismatches (missing ones included) and the greatest difference of two pitch tables."""
    rows = a.select("clip_id", "frame_idx", F.col("f0").alias("x"), F.lit(True).alias("ina")).join(b.select("clip_id", "frame_idx", F.col("f0").alias("y"), F.lit(True).alias("inb")), ["clip_id", "frame_idx"], "full")
    close = F.when(F.col("x").isNull() | F.col("y").isNull(), F.col("x").isNull() & F.col("y").isNull()).otherwise(F.abs(F.col("x") - F.col("y")) <= atol + rtol * F.abs("y"))
    ok = F.col("ina").isNotNull() & F.col("inb").isNotNull() & close
    return rows.agg(F.count(F.lit(1)).alias("frames"), F.count_if(~ok).alias("mismatches"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_diff"))


def reference_band(metrics: DataFrame, references: list, group: str = "raga") -> DataFrame:
    """One row: the least precision and the greatest residual of the reference classes' means."""
    means = metrics.where(F.col(group).isin(references)).groupBy(group).agg(F.avg("prec_corrected").alias("p"), F.avg("residual").alias("r"))
    return means.agg(F.min("p").alias("least_precision"), F.max("r").alias("greatest_residual"))


def slowest(timings: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` clips that took longest (``clip, seconds``)."""
    return timings.orderBy(F.desc("seconds"), "clip").limit(k)
