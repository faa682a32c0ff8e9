"""SimHash fingerprints and the search within a Hamming radius, by DataFrame functions only.

A text's terms are its words in lower case. Every occurrence of a term votes, with
the term's length as its weight, for (bit set) or against (bit clear) each of the
64 bits of the term's hash; a bit of the fingerprint is set if the votes for it
outweigh those against. Votes of two bits share one long in the sums: a text's
weights add up to at most its characters, so 31 bits suffice for each.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchloom.llm.common import id_text, partitions

BITS = 64
#: At most so many bounds are searched for a row; finer buckets divide the gaps evenly.
BOUNDS = 512


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints (longs)."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def fingerprints(df: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """One row per distinct ``keys``: for each ``name: text column`` of ``texts`` a fingerprint (long).

    Texts must not be null. A text without words has fingerprint 0. If ``df`` is
    dealt by some of the keys already, nothing is shuffled; else only partial sums are.
    """
    variants = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("t")) for i, c in enumerate(texts.values())]))
    words = df.select(*keys, variants.alias("_v")).select(*keys, F.col("_v.i").alias("_i"), F.explode(F.split(F.lower("_v.t"), "[ \\t-\\r]+")).alias("_w"))
    votes = words.select(*keys, "_i", F.xxhash64("_w").alias("_h"), F.length("_w").cast("long").alias("_n"))
    pair = F.lit(1 << 32 | 1)
    sums = [F.sum(F.shiftrightunsigned("_h", j).bitwiseAND(pair) * F.col("_n")).alias(f"_s{j}") for j in range(32)]
    voted = votes.groupBy(*keys, "_i").agg(*sums, F.sum("_n").alias("_all"))
    bits = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"_s{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"_s{j}", 32)
        for at, sum_ in ((j, low), (j + 32, high)):
            bits = bits.bitwiseOR(F.when(sum_ * 2 > F.col("_all"), F.lit((1 << at) - (1 << 64 if at == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    prints = voted.select(*keys, "_i", bits.alias("_f"))
    return prints.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_f"))).alias(name) for i, name in enumerate(texts)])


def _bucket(docs: DataFrame, buckets: int) -> Column:
    """A number that rises with ``doc_id``, the same in every run; about equal shares of the rows have each.

    The bounds are quantiles of the ids (at most ``BOUNDS``), read from that column alone.
    """
    few = min(buckets, BOUNDS)
    found = docs.agg(F.percentile_approx("doc_id", [k / few for k in range(1, few)] or [1.0], 10 * few).alias("q"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    if found["a"] is None:
        return F.lit(0)
    bounds = sorted({*found["q"], found["b"] + 1} - {found["a"]})
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    coarse = F.size(F.filter(array, lambda b: b <= F.col("doc_id")))
    fine = max(1, buckets // few)
    if fine == 1:
        return F.coalesce(coarse, F.lit(-1))
    low = F.when(coarse == 0, F.lit(found["a"])).otherwise(F.element_at(array, F.greatest(coarse, F.lit(1))))
    width = F.greatest(F.element_at(array, coarse + 1) - low, F.lit(1))
    return F.coalesce(coarse * fine + F.floor((F.col("doc_id") - low) * F.lit(fine) / width).cast("int"), F.lit(-1))


def _next(df: DataFrame, value: str, to: str) -> DataFrame:
    """Adds ``to``: ``value`` of the next row by ``_b, _r``; after the last row comes the first.

    The rows of a bucket stay together; only each bucket's first value is sent on.
    """
    inside = df.withColumn("_lead", F.lead(F.struct(value)).over(W.partitionBy("_b").orderBy("_r")))
    firsts = df.where(F.col("_r") == 1).select("_b", value)
    # A row per bucket; their number is chosen, and does not grow with the rows of one.
    order = W.orderBy("_b")
    following = firsts.select("_b", F.coalesce(F.lead(F.struct(value)).over(order), F.first(F.struct(value)).over(order)).alias("_first"))
    joined = inside.join(following, "_b")
    return joined.withColumn(to, F.coalesce("_lead", "_first")[value]).drop("_lead", "_first")


def digests(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness.

    In the edited form the last ``floor(n_chars / 2)`` code points give way to the
    first as many (or all) of the next document by ``doc_id``, the first following
    the last; rows with equal ids are ordered by text, and each has its row. Null texts
    are empty; null ids come first; a text without words has fingerprint 0. An empty
    table gives an empty one, and a single row is its own next. Further columns are left
    out, whatever their names. One shuffle deals the texts by ranges of ids; all else
    happens where they lie.
    """
    rows = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    bucketed = rows.withColumn("_b", _bucket(rows, buckets or 4 * partitions(docs.sparkSession)))
    order = W.partitionBy("_b").orderBy("doc_id", "text")
    placed = bucketed.select("_b", "doc_id", "text", F.row_number().over(order).alias("_r"), F.lead(F.struct("text")).over(order).alias("_lead"))
    half = F.floor(F.length("text") / 2).cast("int")
    # Two steps, so that no whole text leaves its bucket: numbers say how much a bucket's
    # last text needs, and only so much of the next bucket's first text is sent back.
    ranks = W.orderBy("_b")  # a row of numbers per bucket
    behind = F.struct("_b", half.alias("need"))
    ends = placed.where("_lead is null").select("_b", behind.alias("_end"))
    before = ends.select("_b", F.coalesce(F.lag("_end").over(ranks), F.last("_end").over(ranks.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_end"))
    heads = placed.where("_r = 1").select("_b", "text").join(before, "_b").select(F.col("_end._b").alias("_b"), F.left("text", F.col("_end.need")).alias("_first"))
    both = placed.join(heads, "_b").withColumn("_next", F.coalesce(F.col("_lead.text"), F.col("_first")))
    both = both.select("_b", "_r", "doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.concat(F.left("text", F.length("text") - half), F.left("_next", half)).alias("_edited"))
    keys = ["_b", "_r", "doc_id", "n_chars", "edited_sha256"]
    prints = fingerprints(both.withColumn("edited_sha256", F.sha2("_edited", 256)), keys, {"f": "text", "e": "_edited"})
    out = _next(prints, "f", "_after")
    return out.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("f")).alias("fingerprint"), as_hex(F.col("e")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("_after")).alias("near_next"))


def neighbours(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs ``a < b`` of distinct fingerprints (column ``f``, long) within ``radius`` bits, with ``distance``.

    The bits are cut into ``blocks`` parts. Two fingerprints that differ in at most
    ``radius`` bits agree in at least ``blocks - radius`` parts, so one table for
    every choice of that many parts, joined on them, finds them all. Documents with
    one fingerprint are one row here: join on ``f`` for the members.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("radius must be less than blocks, and blocks at most 64")
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    mask = lambda k: sum(1 << i for i in range(edges[k], edges[k + 1]))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    tables = [F.struct(F.lit(i).alias("t"), F.col("f").bitwiseAND(F.lit(signed(sum(map(mask, parts))))).alias("k")) for i, parts in enumerate(combinations(range(blocks), blocks - radius))]
    distinct = prints.select(F.col("f").cast("long").alias("f")).dropna().distinct()
    keyed = distinct.select("f", F.explode(F.array(*tables)).alias("_t")).select("f", "_t.*")
    left, right = keyed.select(F.col("f").alias("a"), "t", "k"), keyed.select(F.col("f").alias("b"), "t", "k")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return left.join(right, ["t", "k"]).where((F.col("a") < F.col("b")) & (distance <= radius)).select("a", "b", distance.cast("int").alias("distance")).distinct()
