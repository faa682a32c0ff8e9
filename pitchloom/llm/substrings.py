"""Removal of passages that repeat across documents, by level-wise doubling.

The target is windows of ``length`` words. The levels are lengths of which each is
twice the one before (rounded to end at the target): 13 is reached from 7, 50 from 7
by way of 13 and 25. At every level the windows of that length are listed and those
that stand in two documents or more survive. Only what survives is extended to the
next length, and the loop ends when nothing does.

A level below the target need not list every window. A target window is represented
there by the one of its sub-windows with the least hash (its minimizer): equal target
windows have equal minimizers, so no repeat is lost, and about a quarter of the
windows of 7 words is listed. A target window stays a candidate while its minimizer
survives. At the last level it represents itself, so that the result is exact whatever
came before.

Rows of a level are pairs of a window's hash and a ``doc_id``, each pair once. One
shuffle by hash brings equal windows together in the order of their documents, where a
task decides on them as they pass and holds none. Windows that stand in very many
documents would meet in one task: they are told from a sample, which bounds their
number, and are decided by a map-side aggregation instead, without a shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.llm import shingles, tokens
from pitchloom.llm.common import discard, partitions, small, stored, unused

WINDOW, SHORTEST = 13, 7
#: One document in so many is looked at to tell which windows are frequent; the choice
#: steers where windows are decided, and no result.
SAMPLED = 64
#: A window is frequent if it fills more than this share of a task; at least so many sightings tell.
HEAVY_SHARE, SIGHTINGS = 0.25, 8


def levels(length: int, shortest: int = SHORTEST) -> list[int]:
    """The lengths, ascending: halves of ``length``, rounded up, as long as they are not below ``shortest``."""
    out = [length]
    while out[0] > 1 and -(-out[0] // 2) >= shortest:
        out.insert(0, -(-out[0] // 2))
    return out


class _Windows:
    """Target windows of a slice: where they start, and which text each belongs to."""

    def __init__(self, column, length: int):
        data, offsets = shingles.raw(column)
        starts, ends, self.before = shingles.word_spans(data, offsets)
        self.words = shingles.word_hashes(data, starts, ends, False)
        self.length = length
        counts = np.maximum(0, np.diff(self.before) - length + 1)
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(self.owner)) - (np.cumsum(counts) - counts)[self.owner]
        self.at = self.before[self.owner] + self.place

    def least(self, level: int) -> np.ndarray:
        """For every target window the least hash of its sub-windows of ``level`` words."""
        subs = shingles.windows(self.words, level)
        if not len(self.at):
            return np.zeros(0, np.uint64)
        best = subs[self.at]
        for k in range(1, self.length - level + 1):
            np.minimum(best, subs[self.at + k], out=best)
        return best


def _pairs(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs."""
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def _known(alive, rows: int, owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which pairs of row and hash are in the rows' lists of hashes (64-bit integers as bytes, ascending)."""
    out = np.zeros(len(h), bool)
    bounds = np.searchsorted(owner, np.arange(rows + 1))
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if a < b and (held := alive[k]):
            list_ = np.frombuffer(held, "<u8")
            at = np.minimum(np.searchsorted(list_, h[a:b]), len(list_) - 1)
            out[a:b] = list_[at] == h[a:b]
    return out


def _listed(texts: DataFrame, length: int, level: int, before: int | None) -> DataFrame:
    """``h, doc_id``: the level's windows of ``doc_id, text`` rows (and ``hs``, what survived of the level ``before``)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in shingles.slices(batch, 1):
                w = _Windows(part.column(1), length)
                owner, h = w.owner, w.least(level)
                if before is not None:
                    keep = _known(part.column(2).to_pylist(), part.num_rows, owner, w.least(before))
                    owner, h = owner[keep], h[keep]
                owner, h = _pairs(owner, h)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column(0).take(pa.array(owner))], ["h", "doc_id"])

    return texts.mapInArrow(tokens.gives_back(run), "h long, doc_id long")


def _later(rows: DataFrame, first_too: bool) -> DataFrame:
    """Of ``h, doc_id`` rows those whose hash has a smaller ``doc_id``; with ``first_too`` the least one of such a hash as well."""

    def run(batches):
        import pyarrow as pa

        key, least, told = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            h, doc = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            new[0] = h[0] != key
            begin = np.flatnonzero(new) if new[0] else np.append(0, np.flatnonzero(new))
            group = np.cumsum(new) - int(new[0])
            first = doc[begin].copy()
            if not new[0]:
                first[0] = least
            fresh = np.ones(len(begin), bool)
            fresh[0] = bool(new[0]) or not told
            later = doc > first[group]
            any_ = np.zeros(len(begin), bool)
            any_[group[later]] = True
            out_h, out_d = h[later], doc[later]
            if first_too:
                add = any_ & fresh
                out_h, out_d = np.append(out_h, h[begin[add]]), np.append(out_d, first[add])
            key, least, told = h[-1], first[-1], bool(any_[-1]) or not bool(fresh[-1])
            yield pa.RecordBatch.from_arrays([pa.array(out_h), pa.array(out_d)], ["h", "doc_id"])

    return rows.mapInArrow(tokens.gives_back(run), "h long, doc_id long")


def _decided(listed: DataFrame, last: bool) -> DataFrame:
    """The rows of a stored level that survive; at the ``last`` level, only those behind the first document."""
    spark = listed.sparkSession
    parts = partitions(spark)
    total = listed.count()
    least = max(SIGHTINGS, total * HEAVY_SHARE / parts / SAMPLED)
    seen = listed.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    # No more than the rows that fill the tasks allow for: parts / HEAVY_SHARE, with room for chance.
    heavy = [r["h"] for r in seen.where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(int(4 * parts / HEAVY_SHARE)).collect()]
    if not heavy:
        return _later(listed.repartition(parts, "h").sortWithinPartitions("h", "doc_id"), not last)
    names = F.broadcast(small(spark, [(h,) for h in heavy], {"h": "int64"}))
    light = listed.join(names, "h", "left_anti").repartition(parts, "h").sortWithinPartitions("h", "doc_id")
    often = listed.join(names, "h")
    bounds = often.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    often = often.join(F.broadcast(bounds), "h").where("doc_id > a" if last else "true")
    return _later(light, not last).unionByName(often.select("h", "doc_id"))


def _by_document(rows: DataFrame) -> DataFrame:
    """``doc_id, hs``: each document's distinct hashes, ascending, as bytes; holds one document's."""

    def run(batches):
        import pyarrow as pa

        key, held = None, []

        def done():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.unique(np.concatenate(held)).view("<u8").tobytes()], pa.binary())], ["doc_id", "hs"])

        for batch in batches:
            doc, h = np.asarray(batch.column(1)), np.asarray(batch.column(0)).view(np.uint64)
            cuts = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc)) if len(doc) else np.zeros(1, int)
            ids, lists = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if held and doc[a] != key:
                    ids.append(key)
                    lists.append(np.unique(np.concatenate(held)).tobytes())
                    held = []
                key = int(doc[a])
                held.append(h[a:b])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, pa.binary())], ["doc_id", "hs"])
        if held:
            yield done()

    return rows.repartition(partitions(rows.sparkSession), "doc_id").sortWithinPartitions("doc_id").mapInArrow(tokens.gives_back(run), "doc_id long, hs binary")


def repeated(docs: DataFrame, length: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """``doc_id, hs``: by document, the hashes of its windows that must go (a table that the caller discards).

    A window of ``length`` words goes if its words also stand, in sequence, in a
    document with a smaller ``doc_id``. Documents without any are absent, as are rows
    with a null ``doc_id``, which has no place in the order. Rows of equal ids do not
    precede each other; a list of hashes holds for all of them. An empty table, or one
    whose texts are null, empty or shorter than the window, gives no rows. A text of any
    length is taken whole; repeated rows change nothing. Hashes have 64 bits.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    alive, before = None, None
    for level in levels(length, shortest):
        texts = rows if alive is None else rows.join(alive.hint("merge"), "doc_id").select("doc_id", "text", "hs")
        listed = stored(_listed(texts, length, level, before), "windows")
        survived = stored(_by_document(_decided(listed, level == length)), "survivors")
        discard(listed, *([alive] if alive is not None else []))
        alive, before = survived, level
        if alive.isEmpty():
            break
    return alive


def _marked(docs: DataFrame, length: int, shortest: int) -> tuple[DataFrame, str]:
    """``docs`` with a binary column of hashes of windows that must go, and that column's name."""
    key, name = unused(docs, "id"), unused(docs, "gone")
    gone = repeated(docs, length, shortest).select(F.col("doc_id").alias(key), F.col("hs").alias(name))
    return docs.withColumn(key, F.col("doc_id").cast("long")).join(gone.hint("merge"), key, "left").drop(key), name


def covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``starts``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def _gone(texts, lists, length: int):
    """For each text with a list: its words' starts and ends, and which of them go; None for the others."""
    import pyarrow as pa

    wanted = [k for k, held in enumerate(lists) if held]
    out = [None] * len(lists)
    if wanted:
        column = texts.take(pa.array(wanted))
        data, offsets = shingles.raw(column)
        begin, end, before = shingles.word_spans(data, offsets)
        h = shingles.word_hashes(data, begin, end, False)
        all_ = shingles.windows(h, length)
        for j, k in enumerate(wanted):
            a, b = int(before[j]), int(before[j + 1])
            own, list_ = all_[a : max(a, b - length + 1)], np.frombuffer(lists[k], "<u8")
            at = np.minimum(np.searchsorted(list_, own), len(list_) - 1)
            out[k] = (begin[a:b] - offsets[j], end[a:b] - offsets[j], covered(np.flatnonzero(list_[at] == own), b - a, length))
    return out


def digests(docs: DataFrame, length: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per row; a null text has no words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in shingles.slices(batch, 1):
                rows = []
                for text, found in zip(part.column(1).cast(pa.binary()).to_pylist(), _gone(part.column(1), part.column(2).to_pylist(), length)):
                    words = (text or b"").split()
                    gone = 0
                    if found is not None:
                        gone = int(found[2].sum())
                        words = [w for w, g in zip(words, found[2].tolist()) if not g]
                    rows.append((len(words) + gone, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
                n, r, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    marked, name = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), length, shortest)
    return marked.select("doc_id", "text", name).mapInArrow(tokens.gives_back(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with the covered words cut out of ``text``, and ``n_chars`` (if it is there) counted anew.

    Each stretch of covered words goes with the white space behind it; everything
    else, and every row, stays as it is, whatever further columns are called.
    """
    plain = docs.withColumn("text", F.col("text").cast("string"))
    at = plain.columns.index("text")
    marked, name = _marked(plain, length, shortest)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in shingles.slices(batch, at):
                lists, texts = part.column(part.num_columns - 1).to_pylist(), part.column(at)
                if any(lists):
                    texts = texts.cast(pa.binary()).to_pylist()
                    for k, found in enumerate(_gone(part.column(at), lists, length)):
                        if found is not None and found[2].any():
                            text, begin, gone = texts[k], found[0], found[2]
                            stop = np.append(begin[1:], len(text))
                            texts[k] = text[: int(begin[0])] + b"".join([text[a:b] for a, b, g in zip(begin.tolist(), stop.tolist(), gone.tolist()) if not g])
                    texts = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([texts if k == at else part.column(k) for k in range(part.num_columns - 1)], names=part.schema.names[:-1])

    out = marked.select(*[F.col(f"`{c}`") for c in plain.columns], name).mapInArrow(tokens.gives_back(run), plain.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
