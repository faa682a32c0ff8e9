"""Packing of token pieces into sequences by length patterns.

The plan is made from the histogram of lengths alone, whose size is bounded by
the capacity, whatever the number of documents:

1. Lengths are put into coarse bins; all patterns of up to ``depth`` bins that
   fill a sequence are enumerated.
2. Non-negative least squares fits repeat counts of the patterns to the coarse
   histogram; the counts are rounded down.
3. Each repeat is realised by actual lengths of its bins that fill a sequence
   without a gap; repeats for which there are none are dropped.
4. The lengths left over are packed by best fit, longest first, many equal
   sequences at a time.

Pieces then learn their places by their rank among the pieces of equal length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchloom.llm import shingles, tokens
from pitchloom.llm.common import id_text, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SALTS = 256


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every whole text, encoded by the tokenizers library.

    The end id follows each document. Only documents over ``capacity`` are cut. A
    null text is empty: one piece with the end id alone. No shuffle.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa

        encoder, step = tokens.ColumnEncoder(tokens.library_encoder(vocabulary, "blank", tokens.COLUMN_CHUNKS)), 4 * capacity
        for batch in batches:
            for part in shingles.slices(batch, 1, tokens.WINDOW):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder(part.column(1))):
                    ids += end
                    rows += [(doc_id, k, at // 4, len(ids[at : at + step]) // 4, zlib.crc32(ids[at : at + step])) for k, at in enumerate(range(0, len(ids), step))]
                ids, *rest = zip(*rows) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, kind) for x, kind in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs).mapInArrow(tokens.gives_back(run), PIECES)


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises ``|a x - b|``, by active sets; few entries are positive."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    slope = a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(slope).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0]):
        free = np.where(passive, -np.inf, slope)
        if passive.all() or free.max() <= tolerance:
            break
        passive[int(free.argmax())] = True
        while True:
            own = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if s.min(initial=1) > 0:
                x[:] = 0
                x[own] = s
                break
            falling = s <= 0
            ratio = x[own][falling] / np.maximum(x[own][falling] - s[falling], 1e-300)
            step = min(1.0, float(ratio.min()))
            x[own] += step * (s - x[own])
            low = own[x[own] <= 1e-12]
            x[low] = 0
            passive[low if len(low) else own[falling][:1]] = False
        slope = a.T @ (b - a @ x)
    return x


def patterns(bins: int, depth: int) -> list[tuple[int, ...]]:
    """All falling tuples of 2 to ``depth`` numbers from 1 that add up to ``bins``."""
    out = []

    def grow(head: tuple[int, ...], left: int):
        if left == 0:
            if len(head) > 1:
                out.append(head)
        elif len(head) < depth:
            for part in range(min(left, head[-1] if head else left), 0, -1):
                if part * (depth - len(head)) >= left:
                    grow((*head, part), left - part)

    grow((), bins)
    return out


class Plan:
    """Groups of equal sequences: ``(repeats, lengths)``."""

    def __init__(self, histogram: dict[int, int], capacity: int, bins: int = 64, depth: int = 3):
        self.capacity = capacity
        self.left = {n: c for n, c in histogram.items() if c > 0}
        self.sorted = sorted(self.left)
        self.groups: list[tuple[int, tuple[int, ...]]] = []
        self._take((capacity,), self.left.get(capacity, 0), 0)
        bins = min(bins, capacity)
        coarse = np.zeros(bins)
        for n, c in self.left.items():
            coarse[self._bin(n, bins) - 1] += c
        shapes = patterns(bins, depth)
        matrix = np.zeros((bins, len(shapes)))
        for k, shape in enumerate(shapes):
            for part in shape:
                matrix[part - 1, k] += 1
        room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        repeats = np.floor(nonnegative_least_squares(matrix, coarse) + 1e-6).astype(np.int64) if coarse.sum() and shapes else []
        for k in np.argsort(-np.asarray(repeats), kind="stable") if len(repeats) else []:
            self._realise(shapes[k], int(repeats[k]), bins, room)
        self._best_fit(room)

    def _bin(self, n: int, bins: int) -> int:
        return -(-n * bins // self.capacity)

    def _fill(self, shape: tuple[int, ...], bins: int, total: int = 0, used: tuple[int, ...] = ()) -> tuple[int, ...]:
        """Lengths still left, one from each bin of ``shape``, the last being what fills the sequence; or none."""
        if len(shape) == 1:
            n = self.capacity - total
            return (*used, n) if self.left.get(n, 0) > used.count(n) else ()
        low, high = (shape[0] - 1) * self.capacity // bins, shape[0] * self.capacity // bins
        for n in self.sorted[bisect_right(self.sorted, low) : bisect_right(self.sorted, high)][::-1]:
            if self.left[n] > used.count(n) and (found := self._fill(shape[1:], bins, total + n, (*used, n))):
                return found
        return ()

    def _take(self, lengths: tuple[int, ...], times: int, keep: int = 1) -> None:
        if not times:
            return
        for n in lengths:
            self.left[n] -= times
            if not self.left[n]:
                del self.left[n]
                self.sorted.pop(bisect_left(self.sorted, n))
        if not keep:
            self.groups.append((times, lengths))

    def _realise(self, shape: tuple[int, ...], times: int, bins: int, room: dict) -> None:
        while times and (chosen := self._fill(shape, bins)):
            m = min([times, *(self.left[n] // chosen.count(n) for n in set(chosen))])
            self._take(chosen, m)
            room.setdefault(0, []).append((m, chosen))
            times -= m

    def _best_fit(self, room: dict[int, list[tuple[int, tuple[int, ...]]]]) -> None:
        """Longest first, each into the sequences with the least room that suffices."""
        free = sorted(room)
        for n, count in sorted(self.left.items(), reverse=True):
            while count:
                at = bisect_left(free, n)
                if at == len(free):
                    each = self.capacity // n
                    m, held = (count // each, (n,) * each) if count >= each else (1, (n,) * count)
                    count -= m * len(held)
                    self._put(room, free, m, held)
                    continue
                gap = free[at]
                m, held = room[gap].pop()
                if not room[gap]:
                    del room[gap]
                    free.pop(at)
                if m > count:
                    self._put(room, free, m - count, held)
                    m = count
                count -= m
                self._put(room, free, m, (*held, n))
        self.left, self.sorted = {}, []
        self.groups += [group for same in room.values() for group in same]

    def _put(self, room: dict, free: list[int], times: int, lengths: tuple[int, ...]) -> None:
        gap = self.capacity - sum(lengths)
        if gap not in room:
            insort(free, gap)
        room.setdefault(gap, []).append((times, lengths))

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of ranks of each length: ``length << 40 | first rank``, first sequence and offset, sorted."""
        at: dict[int, int] = {}
        rows, base = [], 0
        for times, lengths in self.groups:
            offset = 0
            for n in lengths:
                rows.append((n << 40 | at.get(n, 0), base, offset))
                at[n] = at.get(n, 0) + times
                offset += n
            base += times
        key, first, offset = (np.array(x, np.int64) for x in zip(*sorted(rows))) if rows else [np.zeros(0, np.int64)] * 3
        return key, first, offset


def pack(cut: DataFrame, capacity: int = 2048, bins: int = 64, depth: int = 3) -> DataFrame:
    """Give each piece its ``sequence_id`` and ``offset``.

    ``cut`` has at least the columns of :func:`pieces`. Only the histogram (at most
    ``capacity`` counts) and the plan made of it reach the driver. Ranks among equal
    lengths are counted within salts and added up, so that no length, however
    frequent, meets in one task.
    """
    named = cut.select("doc_id", "piece", "start", "length", "ids_crc32")
    counts = named.groupBy("length").count().collect()
    plan = Plan({r["length"]: r["count"] for r in counts}, capacity, bins, depth)
    key, first, offset = plan.places()
    salted = named.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    within = W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_base", F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    ranked = salted.withColumn("_rank", F.row_number().over(within).cast("long")).join(before, ["length", "_salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") - 1 + F.col("_base")).alias("_rank"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, n << 40 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first[at] + rank - (key[at] & ((1 << 40) - 1))), pa.array(offset[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(tokens.gives_back(run), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """Encode, cut and pack whole texts; the pieces are written once, as the plan needs all of them.

    A null text is an empty one (a piece with the end id alone); a null ``doc_id`` stays
    null. Repeated rows are documents of their own, and pieces of equal length may have
    either of two places: rows that agree in everything cannot be told apart. A text of
    any length is cut into as many pieces as it needs. An empty table gives an empty
    one. Further columns are left out, whatever their names.
    """
    return pack(stored(pieces(docs, vocabulary, capacity), "pieces"), capacity)
