"""Jaccard self-join of word shingles by T-occurrence search (DivideSkip).

Documents with one shingle set are a class. Two classes link when their sets'
Jaccard similarity reaches a bound, for which their overlap must reach a
threshold T. An inverted list holds the classes that have a shingle.

1. Order: shingles are ordered by whether their list is long, then by hash. What
   is long is read off a table of counts of fixed size, summed over all documents.
   Any table gives right results; a good one keeps the merged lists short.
2. Short lists: of two sets that overlap in T shingles, the first ``n - T + l`` of
   each share at least ``l``. Only these prefixes are posted, so most shingles are
   never shuffled. Lists of short shingles are merged by counting the pairs in
   them; pairs with fewer than ``l`` hits fall out. A list that turns out to have more
   than ``LIST`` members is treated as long, whatever the table says.
3. Classes whose prefix reaches into long lists may miss hits. Such classes that
   share a long list are candidates without counting; each is tied to the least
   class of the list, so that no pairs are formed.
4. Candidates that hang together meet, with their whole sets, in one task (or, if
   large, block by block), where DivideSkip searches exactly: the lists of a query's
   shingles are divided, the short ones go through a heap merge that skips, and members
   with enough hits are probed in the long ones by binary search. What reaches T is
   linked; sets in the largest component so far are not asked.
5. Links and classes give the components, named by their least ``doc_id``.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.llm import shingles, tokens
from pitchloom.llm.common import discard, partitions, stored, tidy, unused
from pitchloom.llm.graph import Forest, components

CHUNK = 1 << 16
#: Set elements that a block of a large candidate group has, about.
BLOCK = 2_000_000
#: Weight of the longest list's length when a query's lists are divided.
MU = 0.01
#: Where a list over ``HEAPED`` members must be merged, lists are counted as whole arrays instead; beyond
#: ``PROBED`` members with enough hits, so are the long lists, which is then cheaper than to probe them.
HEAPED, PROBED = 128, 48
#: Lists of more members are never merged, whatever the table of counts says of them.
LIST = 256
#: Pairs that are counted at a time, and the hits of a pair that is a candidate without counting.
PAIRS, TIED = 1 << 19, 1 << 40


def required(n: int, percent: int) -> int:
    """The least overlap of a set of ``n`` with any set that it links with."""
    return -(-percent * n // 100)


def shingle_sets(column, words: int):
    """A sorted array of distinct shingle hashes for each text; fewer words make one shingle."""
    data, offsets = shingles.raw(column)
    starts, ends, before = shingles.word_spans(data, offsets)
    h = shingles.word_hashes(data, starts, ends, True)
    all_ = shingles.windows(h, words)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= words:
            yield np.unique(all_[a : b - words + 1])
        else:
            yield shingles.windows(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _class(u: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(u.tobytes(), seed=len(u)) - (1 << 63)


def classes(docs: DataFrame, words: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, c, n`` of every row, and ``chunk, counts`` of the table of ``2 ** bits`` counts, a part per task."""

    def run(batches):
        import pyarrow as pa

        table = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for part in shingles.slices(batch, 1):
                c, n, seen = [], [], []
                for u in shingle_sets(part.column(1), words):
                    c.append(_class(u))
                    n.append(len(u))
                    seen.append(u)
                at = (np.concatenate(seen) & np.uint64((1 << bits) - 1)).astype(np.int64) if seen else np.zeros(0, np.int64)
                np.add.at(table, at, np.uint32(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(c), pa.int32()), pa.nulls(len(c), pa.binary())], ["doc_id", "c", "n", "chunk", "counts"])
        small = np.minimum(table, 255).astype(np.uint8).reshape(-1, CHUNK)
        used = np.flatnonzero(small.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()), pa.array(used, pa.int32()), pa.array([small[k].tobytes() for k in used], pa.binary())], ["doc_id", "c", "n", "chunk", "counts"])

    both = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tokens.gives_back(run), "doc_id long, c long, n long, chunk int, counts binary"), "classes")
    rows = both.where("chunk is null").select("doc_id", "c", "n")
    return both, rows


def long_lists(table: DataFrame, shingles_in_all: int, bits: int) -> np.ndarray:
    """A bit for every place of the table of counts, set where lists are long."""
    mean = shingles_in_all / (1 << bits)
    bound = mean + max(24, 6 * math.sqrt(mean))

    def run(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if chunk not in sums:
                    sums[chunk] = np.zeros(CHUNK, np.uint32)
                sums[chunk] += np.frombuffer(counts, np.uint8)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([np.packbits(sums[k] > bound).tobytes() for k in names], pa.binary())], ["chunk", "long"])

    out = np.zeros((1 << bits) // CHUNK * (CHUNK // 8), np.uint8).reshape(-1, CHUNK // 8)
    parts = table.where("chunk is not null").select("chunk", "counts").repartition(partitions(table.sparkSession), "chunk").mapInArrow(tokens.gives_back(run), "chunk int, long binary")
    for r in parts.collect():  # 2 ** bits / 8 bytes at most
        out[r["chunk"]] = np.frombuffer(r["long"], np.uint8)
    return np.unpackbits(out.ravel()).astype(bool)


def prefixes(docs: DataFrame, words: int, percent: int, bits: int, is_long: np.ndarray, slack: float) -> DataFrame:
    """``h, c, n, long``: the shingles in each row's prefix; ``long`` ones only for prefixes that reach into long lists."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(is_long))

    def run(batches):
        import pyarrow as pa

        long_ = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for part in shingles.slices(batch, 0):
                hs, cs, ns, ls = [], [], [], []
                for u in shingle_sets(part.column(0), words):
                    n = len(u)
                    p = min(n, n - required(n, percent) + least_hits(n, slack))
                    far = long_[(u & np.uint64((1 << bits) - 1)).astype(np.int64)]
                    near = u[~far][:p]
                    rest = u[far][: p - len(near)]
                    hs += [near, rest]
                    cs.append(np.full(len(near) + len(rest), _class(u) if n else 0, np.int64))
                    ns.append(np.full(len(near) + len(rest), n, np.int32))
                    ls += [np.zeros(len(near), bool), np.ones(len(rest), bool)]
                if hs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(cs)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(ls))], ["h", "c", "n", "far"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tokens.gives_back(run), "h long, c long, n int, far boolean")


def least_hits(n, slack: float):
    return 1 + (n * slack).astype(np.int64) if isinstance(n, np.ndarray) else 1 + int(n * slack)


def merged(posted: DataFrame, percent: int) -> DataFrame:
    """``a, b, n, hits``: counts of the pairs in the lists of short shingles, in parts to be summed; others only tie their members to the least.

    The lists pass sorted; what is held is a list of at most ``LIST`` members and the
    counts of about ``PAIRS`` pairs. A list that turns out longer is treated as long.
    """

    def pairs(h, c, n):
        """Counts of the pairs of whole lists of at most LIST members."""
        import pyarrow as pa

        begin = np.append(True, h[1:] != h[:-1])
        place = np.arange(len(h)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]
        left, right = [], []
        for k in range(1, int(place.max(initial=0)) + 1):
            later = np.flatnonzero(place >= k)
            ok = np.minimum(n[later], n[later - k]) * 100 >= percent * np.maximum(n[later], n[later - k])
            left.append(later[ok] - k)
            right.append(later[ok])
        i, j = (np.concatenate(x) if left else np.zeros(0, int) for x in (left, right))
        order = np.lexsort((c[j], c[i]))
        i, j = i[order], j[order]
        start = np.flatnonzero(np.append(True, (c[i][1:] != c[i][:-1]) | (c[j][1:] != c[j][:-1]))) if len(i) else np.zeros(0, int)
        hits = np.diff(np.append(start, len(i)))
        return pa.RecordBatch.from_arrays([pa.array(c[i[start]]), pa.array(c[j[start]]), pa.array(np.minimum(n[i[start]], n[j[start]])), pa.array(hits.astype(np.int64))], ["a", "b", "n", "hits"])

    def ties(a, b):
        import pyarrow as pa

        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) & (a != b) if len(a) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(np.zeros(int(new.sum()), np.int64)), pa.array(np.full(int(new.sum()), TIED))], ["a", "b", "n", "hits"])

    def whole_lists(h, c, n, far):
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(begin, len(h)))
        long_ = np.maximum.reduceat(far, begin) | (size > LIST)
        each = np.repeat(long_, size)
        yield ties(np.repeat(c[begin], size)[each], c[each])
        some = (~long_ & (size > 1)).nonzero()[0]
        upto = np.cumsum(size[some] * (size[some] - 1) // 2) // PAIRS
        for part in np.split(some, np.flatnonzero(upto[1:] != upto[:-1]) + 1) if len(some) else []:
            chosen = np.repeat(np.isin(np.arange(len(size)), part, assume_unique=True), size)
            yield pairs(h[chosen], c[chosen], n[chosen])

    def run(batches):
        rest, head = None, None  # the last list so far; its least class if it is known to be long
        for batch in batches:
            if not batch.num_rows:
                continue
            h, c, n, far = (np.asarray(x) for x in batch.columns)
            n, far = n.astype(np.int64), far.astype(bool)
            if head is not None:
                stop = int(np.argmax(h != head[0])) if (h != head[0]).any() else len(h)
                yield ties(np.full(stop, head[1]), c[:stop])
                h, c, n, far = h[stop:], c[stop:], n[stop:], far[stop:]
                if not len(h):
                    continue
                head = None
            if rest is not None:
                h, c, n, far = (np.concatenate(x) for x in zip(rest, (h, c, n, far)))
            new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
            h, c, n, far = h[new], c[new], n[new], far[new]
            cut = int(np.argmax(h == h[-1]))
            if cut:
                yield from whole_lists(h[:cut], c[:cut], n[:cut], far[:cut])
            rest = (h[cut:], c[cut:], n[cut:], far[cut:])
            if len(rest[0]) > LIST:
                head = (int(rest[0][0]), int(rest[1][0]))
                yield ties(np.full(len(rest[1]), head[1]), rest[1])
                rest = None
        if rest is not None:
            yield from whole_lists(*rest)

    return posted.repartition(2 * partitions(posted.sparkSession), "h").sortWithinPartitions("h", "c").mapInArrow(tokens.gives_back(run), "a long, b long, n long, hits long")


def occurrences(lists: list[np.ndarray], least: int) -> dict[int, int]:
    """Members of at least ``least`` of the ascending lists, with their counts: a heap merge that skips.

    The heap has the next member of every list. If the lists that share the least one are
    too few, as many more are popped as could still not reach ``least``, and all of them
    move by binary search to the least member that is left.
    """
    rows = [x.tolist() for x in lists if len(x)]
    at = [0] * len(rows)
    heap = [(x[0], k) for k, x in enumerate(rows)]
    heapify(heap)
    out = {}
    while len(heap) >= least:
        member = heap[0][0]
        popped = []
        while heap and heap[0][0] == member:
            popped.append(heappop(heap)[1])
        if len(popped) >= least:
            out[member] = len(popped)
            to = member + 1
        else:
            while len(popped) < least - 1 and heap:
                popped.append(heappop(heap)[1])
            if not heap:
                break
            to = heap[0][0]
        for k in popped:
            at[k] = bisect_left(rows[k], to, at[k])
            if at[k] < len(rows[k]):
                heappush(heap, (rows[k][at[k]], k))
    return out


def divide_skip(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (pairs of positions) that span the components of ``sets``.

    Every query is a set outside the largest component so far: of two sets that link
    and hang not together yet, one is. Of its ``n`` lists the ``L`` longest are set
    aside; what occurs in ``T - L`` of the others is found by a heap merge and probed in
    the long ones by binary search. ``L`` follows from ``T`` and the longest list:
    ``T / (MU ln M + 1)``, less than ``T``. Where almost all lists are long, they are
    counted instead: the hits are the same.
    """
    size = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    del order
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    keys, bounds = values[begin], np.append(begin, len(values))
    forest, members, asked, out = Forest(), {}, set(), []
    largest = None  # a member of the largest component so far

    def outside(x: int) -> bool:
        return largest is None or forest.root(x) != forest.root(largest)

    def query(x: int) -> None:
        nonlocal largest
        at = np.searchsorted(keys, sets[x])
        low, high = bounds[at], bounds[at + 1]
        by = np.argsort(low - high, kind="stable")
        t = required(int(size[x]), percent)
        longest = int(high[by[0]] - low[by[0]])
        far = min(t - 1, int(t / (MU * math.log(longest) + 1)))
        # Lists that only the query itself is in can bring no one else nearer to T.
        rest = [k for k in by[far:].tolist() if high[k] - low[k] > 1]
        if len(rest) < t - far:
            return
        if high[rest[0]] - low[rest[0]] <= HEAPED:
            found = occurrences([owner[low[k] : high[k]] for k in rest], t - far)
            found.pop(x, None)
            met = np.fromiter(found, np.int64, len(found))
            hits = np.fromiter(found.values(), np.int64, len(found))
        else:
            # More than T lists are long, as in a family: a heap would take a step for every member.
            hits = np.bincount(np.concatenate([owner[low[k] : high[k]] for k in rest]), minlength=len(sets))
            hits[x] = 0
            met = np.flatnonzero(hits >= t - far)
            hits = hits[met]
        fit = 100 * np.minimum(size[met], size[x]) >= percent * np.maximum(size[met], size[x])
        met, hits = met[fit], hits[fit]
        if len(met) > PROBED:
            hits = hits + np.bincount(np.concatenate([owner[low[k] : high[k]] for k in by[:far].tolist()] or [met[:0]]), minlength=len(sets))[met]
        else:
            for k in by[:far].tolist() if len(met) else []:
                list_ = owner[low[k] : high[k]]
                hits = hits + (list_[np.minimum(np.searchsorted(list_, met), len(list_) - 1)] == met)
        for j in met[100 * hits >= percent * (size[met] + size[x] - hits)].tolist():
            a, b = forest.root(x), forest.root(j)
            if forest.join(a, b):
                out.append((x, j))
                members[min(a, b)] = members.get(a, 1) + members.get(b, 1)
                if largest is None or members[min(a, b)] >= members[forest.root(largest)]:
                    largest = x

    # Once more from the start if the largest component has changed: those left out before may be outside now.
    while rest := [x for x in range(len(sets)) if x not in asked and outside(x)]:
        for x in rest:
            if outside(x):
                asked.add(x)
                query(x)
    return out


def links(sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: spanning links of each group of ``g, c, s`` rows (group, class, sorted set)."""

    def flush(names: list[int], sets_: list[bytes]):
        import pyarrow as pa

        order = sorted({c: k for k, c in enumerate(names)}.items())
        found = divide_skip([np.frombuffer(sets_[k], "<u8") for _, k in order], percent) if len(order) > 1 else []
        a, b = zip(*[(order[i][0], order[j][0]) for i, j in found]) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        key, names, sets_ = None, [], []
        for batch in batches:
            for g, c, s in zip(*(x.to_pylist() for x in batch.columns)):
                if g != key:
                    if len(names) > 1:
                        yield flush(names, sets_)
                    key, names, sets_ = g, [], []
                names.append(c)
                sets_.append(s)
        if len(names) > 1:
            yield flush(names, sets_)

    return sets.repartition(2 * partitions(sets.sparkSession), "g").sortWithinPartitions("g").mapInArrow(tokens.gives_back(run), "a long, b long")


def join(docs: DataFrame, words: int = 4, percent: int = 85, bits: int | None = None, slack: float = 0.02, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Words are runs without ASCII white space, A-Z in lower case. Sets link at
    ``100 * overlap >= percent * union``. A text that is null or without words has no
    shingles and is its own component, as is each row without a link; repeated rows
    and rows with equal sets are linked. Rows with a null ``doc_id`` give links to
    others but name no component. An empty table gives an empty one, and a text of any
    length is taken whole. Further columns are left out, whatever their names. Hashes of
    shingles and sets have 64 bits. The result is a table that the caller may discard.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = bits or max(16, min(26, math.ceil(math.log2(max(1, rows.count()) * 16))))
    table, found = classes(rows, words, bits)
    total = found.agg(F.sum("n")).first()[0] or 0
    is_long = long_lists(table, total, bits)
    counted = merged(prefixes(rows, words, percent, bits, is_long, slack), percent)
    pairs = counted.groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.max("n").alias("n")).where(F.col("hits") >= 1 + F.floor(F.col("n") * slack)).select("a", "b")
    groups = components(pairs)
    least = groups.groupBy("root").agg(F.count(F.lit(1)).alias("m")).select(F.col("root").alias("node"), "root")
    member = groups.select("node", "root").union(least)
    chosen = found.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")).join(member.withColumnRenamed("node", "c"), "c")
    chosen = stored(chosen.select("doc_id", "c", "n", "root"), "members")
    discard(groups)
    blocks = chosen.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("blocks"))
    needed = chosen.join(blocks, "root").select("doc_id", F.col("c").alias("_c"), "root", "blocks")

    def sets(batches):
        import pyarrow as pa

        for batch in batches:
            for part in shingles.slices(batch, 0):
                made = [(_class(u), u.tobytes()) for u in shingle_sets(part.column(0), words)]
                keep = [k for k, c in enumerate(part.column(1).to_pylist()) if made[k][0] == c]
                own = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(1).take(own), part.column(2).take(own), part.column(3).take(own), pa.array([made[k][1] for k in keep], pa.binary())], ["c", "root", "blocks", "s"])

    def classed(batches):
        import pyarrow as pa

        for batch in batches:
            for part in shingles.slices(batch, 0):
                made = [(_class(u), u.tobytes()) for u in shingle_sets(part.column(0), words)]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in made], pa.int64()), pa.array([s for _, s in made], pa.binary())], ["c", "s"])

    # Joined alike at every size: the texts are shuffled once, however few are needed.
    whole = rows.join(needed.hint("merge"), "doc_id").select("text", "_c", "root", "blocks").mapInArrow(tokens.gives_back(sets), "c long, root long, blocks int, s binary")
    # Classes of rows without an id have no key into the texts: they are joined by class.
    alone = rows.where("doc_id is null").select("text").mapInArrow(tokens.gives_back(classed), "c long, s binary").dropDuplicates(["c"])
    whole = whole.unionByName(alone.join(needed.where("doc_id is null").select(F.col("_c").alias("c"), "root", "blocks"), "c").select("c", "root", "blocks", "s"))
    own = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    dealt = whole.select("c", "s", "root", F.explode(others).alias("_b")).select(F.xxhash64("root", "_b.i", "_b.j").alias("g"), "c", "s")
    linked = components(links(dealt, percent))
    named = found.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least")).join(linked.withColumnRenamed("node", "c"), "c", "left").select("c", F.coalesce("root", "c").alias("root"), "least")
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    component = named.select("c", "root").join(smallest, "root").select("c", "component")
    out = found.join(component, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    out = stored(out, "joined")
    discard(table, chosen, linked)
    return out


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of linked documents: that with the least ``doc_id``.

    Documents without words are no copies of each other and stay, as do rows with a
    null ``doc_id``. Of rows that agree in id and text one stays. Columns of any name are
    kept as they are; an empty table gives an empty one.
    """
    key = unused(docs, "id")
    found = join(docs, words, percent)
    kept = stored(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).withColumnRenamed("doc_id", key), "kept")
    discard(found)
    named = docs.withColumn(key, F.col("doc_id").cast("long"))
    out = named.join(kept.select(key).hint("merge"), key, "left_semi")
    if not kept.where("m > 1").isEmpty():
        out = out.dropDuplicates([key, "text"])
    return out.unionByName(named.where(F.col(key).isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])
