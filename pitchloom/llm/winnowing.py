"""Benchmark decontamination by winnowed fingerprints, by DataFrame functions only.

Words are runs of digits, letters a to z (A to Z in lower case) and characters beyond
ASCII. A window is ``span`` consecutive words of an item; an item of fewer words is one
window. Winnowing keeps of every ``span`` consecutive words the least hash of the
``gram``-word sequences in it: two texts that share a window share that fingerprint, so
every shared span of ``span`` words or more is found from a part of the positions. Ties
go to the place, so that one position represents at most ``span - gram + 1`` windows.

Fingerprints of documents meet those of the items; around each hit the windows that it
represents are extended to their full length and compared by a second hash. A window is
told by both hashes (61 and 64 bits), so that chance agreement needs some 10^37 pairs.
Items shorter than ``span`` are looked up in the same way with their own length: there is
one more pass over a text's words for every such length that the items have.

The items' tables are broadcast if they have at most ``BROADCAST_ROWS`` rows, and are
joined by a shuffle beyond that; the texts themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchloom.llm.common import id_text, stored, unused

SPAN, GRAM = 10, 5
#: Tables of fingerprints and windows up to so many rows (some 100 bytes each) are broadcast.
BROADCAST_ROWS = 1 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(text: Column) -> Column:
    """The words of a text; only A to Z change their case."""
    # ``lower`` is fast, but changes other letters too; a text of ASCII has none of these.
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    # Blanks at the front would make an empty first word, those at the end an empty last one.
    return F.array_remove(F.split(plain, _BETWEEN), "")


def _steps(last: Column) -> Column:
    """0 to ``last``; nothing if that is less."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _each(array: Column | str) -> Column:
    """The entries of an array that has some.

    For ``explode`` Spark would infer a filter by the array's size and push it below the
    columns that the array is made from, where lambdas would compute them for every entry.
    """
    return F.explode_outer(array)


def _of_length(df: DataFrame, k: int, length: int, gram: int) -> tuple[DataFrame, Column]:
    wide = length - gram + 1
    at = lambda name, i: F.get(F.col(name), i)
    # The place in the low three bits makes equal hashes of a window differ; windows have at most 8 places.
    ranked = lambda i: F.xxhash64(*[at("_h", i + d) for d in range(gram)]).bitwiseAND(F.lit(-8)).bitwiseOR(i.bitwiseAND(F.lit(7)))
    least = lambda i: F.least(*[at(f"_g{k}", i + d) for d in range(wide)]) if wide > 1 else at(f"_g{k}", i)
    new = lambda i: (i == 0) | (at(f"_m{k}", i) != at(f"_m{k}", i - 1))
    fingerprint = lambda i: F.xxhash64(F.lit(length), at(f"_m{k}", i).bitwiseAND(F.lit(-8)))
    told = lambda i: F.struct(i.alias("i"), fingerprint(i).alias("m"), F.lit(length).alias("len"), F.slice("_h", i + 1, length + wide - 1).alias("h"))
    # Each array is a column of its own, so that no lambda computes another one anew.
    df = df.withColumn(f"_g{k}", F.transform(_steps(F.col("_n") - gram), ranked))
    df = df.withColumn(f"_m{k}", F.transform(_steps(F.col("_n") - length), least))
    return df, F.transform(F.filter(_steps(F.col("_n") - length), new), told)


def _fingerprints(df: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """Adds ``_fps`` to rows with ``_h`` (hashes of words) and ``_n`` (their number).

    An array of ``(i, m, len, h)``: windows of ``len`` words from word ``i`` have the
    fingerprint ``m``, and so have at most ``len - gram`` windows behind it; ``h`` holds
    the hashes of the words of all these.
    """
    parts = []
    for k, length in enumerate(lengths):
        df, fps = _of_length(df, k, length, min(gram, length))
        parts.append(fps)
    return df.withColumn("_fps", F.concat(*parts))


def _full(i: Column, h: Column, length: Column, lengths: list[int], gram: int) -> Column:
    """Array of ``(i, w)``: the windows that a fingerprint stands for, with a hash of all their words."""
    out = None
    for one in lengths:
        windows = [F.struct((i + d).alias("i"), F.xxhash64(F.lit(-one), *[F.get(h, F.lit(d + j)) for j in range(one)]).alias("w")) for d in range(one - min(gram, one) + 1)]
        full = F.slice(F.array(*windows), F.lit(1), F.size(h) - one + 1)
        out = F.when(length == one, full) if out is None else out.when(length == one, full)
    return out


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("_w", _words(F.col("text"))).withColumn("_n", F.size("_w")).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).drop("_w")


def _items(items: DataFrame, span: int, gram: int) -> tuple[DataFrame, list[int]]:
    """``m, w, len, items`` for every distinct window, and the lengths that windows have."""
    texts = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = _hashed(texts).where("_n > 0")
    # At most ``span`` numbers.
    lengths = sorted((r[0] for r in hashed.select(F.least("_n", F.lit(span))).distinct().collect()), reverse=True)
    found = []
    for length in lengths:
        of = hashed.where(F.col("_n") >= span) if length == span else hashed.where(F.col("_n") == length)
        rows = _fingerprints(of, [length], gram).select("item_id", _each("_fps").alias("_f")).select("item_id", "_f.m", _each(_full(F.col("_f.i"), F.col("_f.h"), F.col("_f.len"), [length], gram)).alias("_x"))
        found.append(rows.select("item_id", "m", F.col("_x.w").alias("w"), F.lit(length).alias("len")))
    if not found:
        return hashed.select(F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("w"), F.lit(0).alias("len"), F.array("item_id").alias("items")).where("false"), []
    every = found[0]
    for rows in found[1:]:
        every = every.unionByName(rows)
    # A run of windows with one fingerprint is extended by windows of the next run too: of those only the right ones count.
    return every.groupBy("m", "w", "len").agg(F.array_sort(F.collect_set("item_id")).alias("items")), lengths


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, and ``item_ids`` (sorted).

    A word is hit if it lies in an occurrence of any item's window; ``n_items`` counts the
    items with such windows. A null text has no words, as has one of signs and blanks
    only; such items have no windows. Items that repeat or share an ``item_id`` count
    once; an item without an id marks words and is not named. Every row of ``docs`` gives
    a row, whatever its id (null and repeated ones too). An empty table of documents
    gives no rows, one of items no hits. Texts are taken whole, at any length. Further
    columns are left out, whatever their names.
    """
    if not 1 <= gram <= span or span - gram > 7:
        raise ValueError("gram must be 1 to span words, and at most 7 less than span")
    # The row's number comes from the scan: equal ids, or none, stay apart, and a lost task gives the same numbers.
    rows = id_text(docs).select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    windows, lengths = _items(items, span, gram)
    none = F.struct(F.lit(None).cast("int").alias("i"), F.lit(None).cast("long").alias("m"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("array<long>").alias("h"))
    hashed = _hashed(rows)
    if not lengths:
        return _answers(hashed.select("_row", "doc_id", F.col("_n").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids")))
    windows = stored(windows.withColumn("sig", F.xxhash64("items")), "windows")
    n = windows.count()
    # One more entry without a fingerprint keeps rows that have none, or no hit.
    found = _fingerprints(hashed, lengths, gram).select("_row", "doc_id", F.col("_n").cast("long").alias("n_words"), _each(F.array_append("_fps", none)).alias("_f"))
    found = found.select("_row", "doc_id", "n_words", "_f.*")
    full = F.when(F.col("i").isNull(), F.array(F.struct(F.lit(None).cast("int").alias("i"), F.lit(None).cast("long").alias("w")))).otherwise(_full(F.col("i"), F.col("h"), F.col("len"), lengths, gram))
    keys = windows.select("m", F.lit(True).alias("_known")).distinct()
    if n > BROADCAST_ROWS:
        found = found.withColumn("_x", full).drop("h")
    met = found.join(_small(keys, n), "m", "left").where("_known or i is null")
    if n <= BROADCAST_ROWS:
        met = met.withColumn("_x", full)
    extended = met.select("_row", "doc_id", "n_words", "m", _each("_x").alias("_x")).select("_row", "doc_id", "n_words", "m", "_x.*")
    hit = extended.join(_small(windows.select("m", "w", F.col("len").alias("_len"), "sig"), n), ["m", "w"], "left").where("_len is not null or i is null")
    spans = F.array_sort(F.collect_set(F.when(F.col("_len").isNotNull(), F.struct(F.col("i").alias("a"), (F.col("i") + F.col("_len")).alias("b")))))
    by_row = hit.groupBy("_row", "doc_id", "n_words").agg(spans.alias("_spans"), F.collect_set("sig").alias("_sigs"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    add = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["b"]).alias("to"))
    counted = by_row.select("_row", "doc_id", "n_words", F.aggregate("_spans", start, add)["n"].alias("n_hit"), F.explode_outer("_sigs").alias("sig"))
    # Windows with the same items share one list; a document meets each list once.
    lists = windows.groupBy("sig").agg(F.first("items").alias("items"))
    named = counted.join(_small(lists, n), "sig", "left").groupBy("_row", "doc_id", "n_words", "n_hit").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    return _answers(named)


def _answers(rows: DataFrame) -> DataFrame:
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "item_ids")


def decontaminate(docs: DataFrame, items: DataFrame, most: float = 0.0, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``docs`` without the rows of which more than ``most`` of the words are hit; all columns stay.

    The decision depends on the text alone and is told by a hash of it; ids may be null
    or repeat. See :func:`contamination` for odd texts and tables.
    """
    key = unused(docs, "key")
    marked = docs.withColumn(key, F.xxhash64(F.col("text").cast("string"), F.lit(1)))
    hits = contamination(marked.select(F.col(key).alias("doc_id"), "text"), items, span, gram)
    bad = hits.where(F.col("n_hit") > most * F.col("n_words")).select(F.col("doc_id").alias(key)).distinct()
    return marked.join(bad, key, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
