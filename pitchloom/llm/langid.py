"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter has, at every slot, one bit per language. Learning sets
a language's bit at the slots of its n-grams; a lookup is the AND of an n-gram's
slots and gives all languages that contain it at once. A text's n-grams are
looked up, the bits are counted by language, and each count is corrected for the
false positives that the filling of that language's bits lets expect. The
language with the largest corrected count is the prediction.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from pitchloom.llm import shingles, tokens
from pitchloom.llm.common import discard, small, stored

#: About so many labelled documents of each language are used for fitting.
SAMPLE_PER_LANGUAGE = 3000
#: Lengths of n-grams, in letters; a blank before or behind a word counts as one.
LENGTHS = (2, 3, 4)
#: Least share of a language's n-grams of one length that an n-gram must have. This
#: bounds each language's entries by ``len(LENGTHS) / LEAST_SHARE``.
LEAST_SHARE = 2e-5
#: Least share relative to that of the language where the n-gram is most common.
LEAST_RATIO = 0.2
SLOTS, HASHES = 1 << 20, 3
#: Bytes of text that a worker takes up at a time, and characters that it looks at together.
SLICE, PIECE = 1 << 20, 1 << 17
UNDECIDED = "und"
#: Some character that is no letter.
_NO_LETTER = re.compile(r"[\W\d_]")

_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass
class Filter:
    """``slots[s, i]`` holds 64 languages' bits; ``wrong`` is each language's false-positive rate."""

    languages: list[str]
    slots: np.ndarray
    wrong: np.ndarray
    common: int


@lru_cache(1)
def _letters() -> np.ndarray:
    """By code point: the code point of a letter, 0 for anything else."""
    points = np.arange(0x110000, dtype=np.uint32)
    ok = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(ok, points, 0).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def pieces(texts: list[str | None], most: int = PIECE):
    """``(parts, owners)``: the texts, cut before characters that are no letters into parts of about ``most`` characters, as many at a time.

    No n-gram reaches across such a character, so the parts have the n-grams of the texts.
    A very long text is not looked at as a whole, but for a run of letters in it, which
    is never cut.
    """
    parts, owners, held = [], [], 0
    for k, text in enumerate(texts):
        text = text or ""
        at = 0
        while at < len(text):
            cut = _NO_LETTER.search(text, at + most - held)
            end = cut.start() if cut else len(text)
            parts.append(text[at:end])
            owners.append(k)
            held += end - at
            at = end
            if held >= most:
                yield parts, np.array(owners)
                parts, owners, held = [], [], 0
    if parts:
        yield parts, np.array(owners)


def ngrams(texts: list[str | None]):
    """Whether each text has a letter, and a generator of the n-grams' hashes and text numbers, by length.

    Words are runs of letters in lower case, framed by blanks; an n-gram lies within
    one framed word.
    """
    lows = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) for t in lows], np.int64)
    raw = np.frombuffer("\n".join(["", *lows, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = _letters()[np.minimum(raw, 0x10FFFF)]
    letter = points != 0
    owner = np.append([0], np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1))
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    x, owner = points[keep].astype(np.uint64), owner[keep]
    blank = x == 0

    def each():
        for n in LENGTHS:
            m = max(0, len(x) - n + 1)
            h = np.full(m, np.uint64(n))
            ok = np.ones(m, bool)
            for k in range(n):
                h = h * _M[0] + x[k : k + m] + np.uint64(1)
                if 0 < k < n - 1:
                    ok &= ~blank[k : k + m]
            yield _mix(h[ok]), np.where(blank[:m], owner[1 : m + 1], owner[:m])[ok]

    return has, each()


class _Counts:
    """Sums by language, length and hash, held until there are many."""

    MOST = 300_000

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, l: int, n: int, h: np.ndarray):
        value, count = np.unique(h, return_counts=True)
        self.parts.append((np.full(len(value), l, np.int32), np.full(len(value), n, np.int32), value, count))
        self.size += len(value)
        if self.size >= 2 * self.MOST:
            self._merge()
            if self.size >= self.MOST:
                yield self.take()

    def _merge(self):
        l, n, h, c = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((h, n, l))
        l, n, h, c = l[order], n[order], h[order], c[order]
        at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (n[1:] != n[:-1]) | (l[1:] != l[:-1])))
        self.parts, self.size = [(l[at], n[at], h[at], np.add.reduceat(c, at))], len(at)

    def take(self):
        import pyarrow as pa

        if self.parts:
            self._merge()
        l, n, h, c = self.parts[0] if self.parts else [np.zeros(0, t) for t in (np.int32, np.int32, np.uint64, np.int64)]
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(l), pa.array(n), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["l", "n", "h", "c"])


def _slots(h: np.ndarray, k: int) -> np.ndarray:
    return ((h >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64)


def fit(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Filter:
    """A filter from ``doc_id, text, lang`` rows; rows with a null in any of these are left out.

    Of each language about ``sample`` whole documents, chosen by a hash of their id,
    are read. What reaches the driver is bounded by the least share.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropna()
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    slices = max(1, -(-len(languages) // 64))
    if not languages:
        return Filter([], np.zeros((slices, SLOTS), np.uint64), np.zeros(0), 0)
    number = {name: k for k, name in enumerate(languages)}
    share = small(spark, [(name, number[name], min(1.0, sample / n)) for name, n in sizes.items()], {"lang": "string", "l": "int32", "share": "double"})
    chosen = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("text", "l")

    def run(batches):
        counts = _Counts()
        for batch in batches:
            for part in shingles.slices(batch, 0, SLICE):
                langs = part.column(1).to_numpy()
                for parts, owners in pieces(part.column(0).to_pylist()):
                    for n, (h, owner) in zip(LENGTHS, ngrams(parts)[1]):
                        by = langs[owners[owner]]
                        for l in np.unique(by).tolist():
                            yield from counts.add(l, n, h[by == l])
        yield counts.take()

    counts = chosen.mapInArrow(tokens.gives_back(run), "l int, n int, h long, c long").groupBy("l", "n", "h").agg(F.sum("c").alias("c"))
    counts = stored(counts, "ngrams")
    try:
        totals = {(r["l"], r["n"]): r["t"] for r in counts.groupBy("l", "n").agg(F.sum("c").alias("t")).collect()}
        whole = small(spark, [(l, n, float(t)) for (l, n), t in totals.items()], {"l": "int32", "n": "int32", "t": "double"}) if totals else None
        if whole is None:
            return Filter(languages, np.zeros((slices, SLOTS), np.uint64), np.zeros(len(languages)), 0)
        shares = counts.join(F.broadcast(whole), ["l", "n"]).select("l", "h", (F.col("c") / F.col("t")).alias("f")).where(F.col("f") >= LEAST_SHARE)
        kept = shares.toArrow()
    finally:
        discard(counts)
    l, h, f = kept["l"].to_numpy(), kept["h"].to_numpy().view(np.uint64), kept["f"].to_numpy()
    values, place = np.unique(h, return_inverse=True)
    most = np.zeros(len(values))
    np.maximum.at(most, place, f)
    good = f >= LEAST_RATIO * most[place]
    l, h = l[good].astype(np.int64), h[good]
    slots = np.zeros((slices, SLOTS), np.uint64)
    for k in range(HASHES):
        np.bitwise_or.at(slots, (l // 64, _slots(h, k)), np.uint64(1) << (l % 64).astype(np.uint64))
    filled = np.array([((slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
    return Filter(languages, slots, filled**HASHES, number[max(languages, key=lambda x: (sizes[x], x))])


def decide(filter_: Filter, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and score of each text.

    The score is the predicted language's share of all corrected counts, taken
    beyond even shares: 0 if all languages fit alike, 1 if no other fits at all.
    """
    n, names = len(texts), filter_.languages
    has, seen, counts = np.zeros(n, bool), np.zeros(n), np.zeros((max(1, len(names)), n))
    for parts, owners in pieces(texts):
        found, grams = ngrams(parts)
        np.logical_or.at(has, owners, found)
        for h, owner in grams:
            owner = owners[owner]
            seen += np.bincount(owner, minlength=n)
            for s, slots in enumerate(filter_.slots):
                mask = slots[_slots(h, 0)]
                for k in range(1, HASHES):
                    mask &= slots[_slots(h, k)]
                for l in range(64 * s, min(64 * s + 64, len(names))):
                    counts[l] += np.bincount(owner, weights=(mask >> np.uint64(l % 64)) & np.uint64(1), minlength=n)
    if not names:
        return [UNDECIDED] * n, np.zeros(n)
    counts = np.maximum(0, counts - seen * filter_.wrong[:, None]) / (1 - np.minimum(filter_.wrong, 0.999))[:, None]
    total = counts.sum(axis=0)
    best = np.where(total > 0, counts.argmax(axis=0), filter_.common)
    even = 1 / len(names)
    share = counts.max(axis=0) / np.maximum(total, 1e-12)
    score = np.clip((share - even) / (1 - even), 0, 1) if len(names) > 1 else share
    return [names[b] if ok else UNDECIDED for b, ok in zip(best, has)], np.where(has & (total > 0), np.clip(score, 0, 1), 0.0)


def predict(docs: DataFrame, filter_: Filter, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two columns, named by ``into``: the predicted language and its score. No shuffle.

    Only ``text`` is looked at, whole, however long. A text that is null or has no
    letter is ``und`` with score 0. A text none of whose n-grams is known gets the most
    frequent learned language with score 0; a filter without languages says ``und``.
    Columns of ``docs`` that have the names of ``into`` give way to the new ones; all
    others and all rows, repeated ones too, are kept. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filter_)
    taken = {c.lower() for c in into}
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]).withColumn("text", F.col("text").cast("string"))
    at = plain.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in shingles.slices(batch, at, SLICE):
                names, score = decide(shared.value, part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, *into])

    schema = StructType([*plain.schema.fields, StructField(into[0], StringType()), StructField(into[1], DoubleType())])
    return plain.mapInArrow(tokens.gives_back(run), schema)


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a letter. No shuffle."""
    plain = docs.withColumn("text", F.col("text").cast("string"))
    at = plain.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in shingles.slices(batch, at, SLICE):
                yield part.filter(pa.array([any(map(str.isalpha, (t or "").lower())) for t in part.column(at).to_pylist()], pa.bool_()))

    return plain.mapInArrow(tokens.gives_back(run), plain.schema)


def held_out(docs: DataFrame):
    """The fold that is never learned from: crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
