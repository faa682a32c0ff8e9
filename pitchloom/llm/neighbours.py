"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

Equal vectors are one node, with the least ids of its members (as many as a result
can name). The graph starts from leaves: a few random hyperplane codes group the
nodes, and within a leaf every node meets all others. Then rounds of joins bring
neighbours of neighbours together: every node's neighbours, forward and reverse,
meet at that node, and pairs nearer than what either has are proposed, until a round
changes few edges. A node with very many reverse neighbours is split into groups,
other ones in every round, so that no task holds them all and none is dropped.
Queries start at their own node or at entry points and follow the graph from the
nearest nodes not yet expanded, all queries at once, one join per step, until all of
the beam is expanded. Distances are exact when results are ranked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchloom.llm.common import discard, partitions, stored

LEAF, TREES, DEGREE = 400, 4, 28
#: Rounds end when one changes less than this share of the edges.
FEW = 0.02
BEAM, EXPAND = 256, 128
GROUP = 96
#: Numbers that one step of a task compares at a time.
CELLS = 1 << 19


def usable(embedding: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    inf = F.lit(float("inf"))
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(embedding, lambda x: x != 0)


def vectors(table: DataFrame) -> DataFrame:
    """``vec_id, v`` of rows that take part: float64 bytes of the vectors of the most common length."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & usable(F.col("e")))
    common = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("e") == (common["n"] if common else 0))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).astype("<f8") + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x.reshape(batch.num_rows, -1)] if batch.num_rows else [], pa.binary())], ["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v binary")


def nodes(found: DataFrame, members: int) -> DataFrame:
    """``node, v, ids``: distinct vectors, named by their least id, with their ``members`` least ids.

    Where different vectors have the same least id, the first of them has the name; the
    others are named by a hash.
    """

    def least(batches):
        import pyarrow as pa

        for batch in batches:
            held: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(v, []).append(i)
            rows = [(v, i) for v, ids in held.items() for i in sorted(set(ids))[:members]]
            v, i = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(v, pa.binary())], ["vec_id", "v"])

    ranked = found.mapInArrow(least, "vec_id long, v binary").distinct().withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id")))
    named = ranked.where(F.col("r") <= members).groupBy("v").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    turn = F.row_number().over(W.partitionBy("node").orderBy("v"))
    return named.withColumn("r", turn).select(F.when(F.col("r") == 1, F.col("node")).otherwise(F.xxhash64("v")).alias("node"), "v", "ids")


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1) if rows else np.zeros((0, 1))


def _unpacked(column) -> np.ndarray:
    """The vectors of ``s``, in double precision: the first byte is the number of bytes of a component."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join([r[1:] for r in rows]), f"<f{rows[0][0]}").reshape(len(rows), -1).astype(np.float64) if rows else np.zeros((0, 1))


def _met(x: np.ndarray, sizes: np.ndarray, k: int, reach: np.ndarray | None = None, fresh: np.ndarray | None = None):
    """Yields rows ``a``, ``b`` and squared distances: the ``k`` nearest others of every row in its group, ties included.

    Groups are runs of ``sizes`` rows. Only pairs with a ``fresh`` row count, and only those
    nearer than what ``a`` has (``reach``). Products, taken around the group's medians so
    that they keep their digits, choose; what is chosen is measured by differences. Groups
    of like size are taken together, within a bound on memory.
    """
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 1]
    at = 0
    while at < len(order):
        to, most = at + 1, int(sizes[order[at]])
        while to < len(order) and (to + 1 - at) * (m := int(sizes[order[to]])) * max(m, x.shape[1]) <= CELLS:
            to += 1
        own, most = order[at:to], int(sizes[order[to - 1]])
        at = to
        place = np.arange(most)
        row = starts[own][:, None] + np.minimum(place, sizes[own][:, None] - 1)
        there = place < sizes[own][:, None]
        y = x[row]
        with np.errstate(over="ignore", invalid="ignore"):
            y -= np.median(y, axis=1, keepdims=True)
            square = (y * y).sum(2)
            d = square[:, :, None] + square[:, None, :] - 2 * y @ y.transpose(0, 2, 1)
            unsure = (x.shape[1] + 4) * 2.0**-51 * (square[:, :, None] + square[:, None, :])
        apart = ~(there[:, :, None] & there[:, None, :])
        apart[:, place, place] = True
        if fresh is not None:
            apart |= ~(fresh[row][:, :, None] | fresh[row][:, None, :])
        d[np.isnan(d)] = 0.0
        np.minimum(d, np.finfo(float).max, out=d)
        d[apart] = np.inf
        if reach is not None:
            d[~(d - unsure < reach[row][:, :, None])] = np.inf
        chosen = d < np.inf
        if most > k + 1:
            chosen &= d - unsure <= np.partition(d + unsure, k - 1, axis=2)[:, :, k - 1 : k]
        g, i, j = np.nonzero(chosen)
        for c in range(0, len(g), 1 << 16):
            a, b = row[g[c : c + (1 << 16)], i[c : c + (1 << 16)]], row[g[c : c + (1 << 16)], j[c : c + (1 << 16)]]
            exact = ((x[a] - x[b]) ** 2).sum(1)
            ok = np.ones(len(a), bool) if reach is None else exact < reach[a]
            yield a[ok], b[ok], exact[ok]


def _edges(a, b, d):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(d.astype(np.float64))], ["a", "b", "d"])


def _grouped(batches, rows: int = 20_000):
    """Record batches of whole runs of equal first columns, of about ``rows`` rows, and the runs' sizes."""
    import pyarrow as pa

    def cut(held, last: bool):
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = np.asarray(whole.column(0))
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        upto = len(keys) if last else int(begin[-1])
        sizes = np.diff(np.append(begin if last else begin[:-1], upto))
        return whole.slice(0, upto), sizes, whole.slice(upto)

    held, count = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            run, sizes, rest = cut(held, False)
            held, count = [rest], 0
            if len(sizes):
                yield run, sizes
    if held:
        run, sizes, _ = cut(held, True)
        yield run, sizes


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """Each node's ``degree`` nearest of the proposed neighbours."""
    order = W.partitionBy("a").orderBy("d", "b")
    return edges.groupBy("a", "b").agg(F.min("d").alias("d"), F.min("round").alias("round")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= degree).drop("r")


def build(found: DataFrame, degree: int = DEGREE, trees: int = TREES, leaf: int = LEAF, rounds: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``a, b, d``: the graph over ``node, v`` rows; and ``node, s``: the vectors it was built on, without loss.

    Rounds go on until few edges change, or to ``rounds`` if that is given. There is at
    least one at every size.
    """
    spark = found.sparkSession
    count = found.count()
    bits = max(0, min(20, int(np.ceil(np.log2(max(1, count / leaf))))))

    def codes(batches):
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column(1))
            for t in range(trees if bits else 1):
                planes = np.random.default_rng(seed + t).normal(size=(x.shape[1], max(1, bits)))
                code = ((x @ planes > 0) @ (1 << np.arange(max(1, bits)))) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(t * (1 << 20) + code.astype(np.int64)), batch.column(0)], ["g", "node"])

    coded = found.select("node", "v").mapInArrow(codes, "g long, node long")
    share = coded.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(2.0 * leaf)).cast("int").alias("parts"))
    dealt = coded.join(share, "g").select(F.xxhash64("g", F.pmod(F.xxhash64("node", "g"), F.col("parts"))).alias("g"), "node")

    def leaves(batches):
        for run, sizes in _grouped(batches):
            names, x = np.asarray(run.column(1)), _unpacked(run.column(2))
            for a, b, d in _met(x, sizes, degree):
                yield _edges(names[a], names[b], d)

    single = found.select("node", "v").mapInArrow(_single, "ok boolean").agg(F.min("ok")).first()[0]
    kind = 8 if single is False else 4

    def shortened(batches):
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column(1)).astype(f"<f{kind}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bytes([kind]) + v.tobytes() for v in x], pa.binary())], ["node", "s"])

    short = stored(found.select("node", "v").mapInArrow(shortened, "node long, s binary"), "short-vectors")
    many = 2 * partitions(spark)
    met = dealt.join(short, "node").select("g", "node", "s").repartition(many, "g").sortWithinPartitions("g")
    graph = stored(_best(met.mapInArrow(leaves, "a long, b long, d double").withColumn("round", F.lit(0)), degree), "graph")

    def proposals(batches):
        # A node's nearest ``degree`` of a group are all that can be among its nearest of all groups.
        for run, sizes in _grouped(batches):
            names, reach, fresh = np.asarray(run.column(1)), np.asarray(run.column(2)), np.asarray(run.column(3)).astype(bool)
            for a, b, d in _met(_unpacked(run.column(4)), sizes, degree, reach, fresh):
                yield _edges(names[a], names[b], d)

    turn = 0
    while rounds is None or turn < rounds:
        turn += 1
        reach = graph.groupBy("a").agg(F.when(F.count(F.lit(1)) < degree, F.lit(float("inf"))).otherwise(F.max("d")).alias("reach"))
        ways = graph.select(F.col("a").alias("at"), F.col("b").alias("node"), "round").union(graph.select(F.col("b").alias("at"), F.col("a").alias("node"), "round"))
        own = ways.groupBy("at", "node").agg((F.max("round") == turn - 1).alias("fresh"))
        # Only where an edge is new since the last round can a pair meet that has not met.
        sizes = own.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).cast("int").alias("parts"), F.max("fresh").alias("any")).where("any")
        grouped = own.join(sizes, "at").select(F.xxhash64("at", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("parts"))).alias("g"), "node", "fresh", (F.col("parts") > 1).alias("split"))
        carried = short.join(reach.withColumnRenamed("a", "node"), "node")
        # Of a split group old pairs may not have met either, as they were in other parts.
        met = grouped.join(carried, "node").select("g", "node", "reach", (F.col("fresh") | F.col("split")).alias("fresh"), "s").repartition(many, "g").sortWithinPartitions("g")
        nearer = met.mapInArrow(proposals, "a long, b long, d double").withColumn("round", F.lit(turn))
        after = stored(_best(graph.union(nearer), degree), "graph")
        discard(graph)
        graph = after
        changed = graph.agg(F.coalesce(F.avg((F.col("round") == turn).cast("double")), F.lit(0.0))).first()[0]
        if changed < FEW:
            break
    return graph.select("a", "b", "d"), short


def _single(batches):
    """Whether single precision holds every component as it is."""
    import pyarrow as pa

    for batch in batches:
        x = _matrix(batch.column(1))
        with np.errstate(over="ignore"):
            yield pa.RecordBatch.from_arrays([pa.array([bool((x.astype("<f4") == x).all())])], ["ok"])


def search(start: DataFrame, short: DataFrame, graph: DataFrame, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """``q, node, d``: each query's ``beam`` nearest nodes met, with squared distances.

    ``start`` has ``q, x, node``: the query's vector, written like ``short``, and nodes
    to begin at. A step expands each query's ``expand`` nearest nodes of the beam that
    are not expanded yet; the search ends when there are none. The query's vector
    travels to the nodes, and only distances come back.
    """
    ways = stored(graph.select("a", "b").union(graph.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ways")
    asked = stored(start.select("q", "x").dropDuplicates(["q"]), "asked")

    def measured(batches):
        import pyarrow as pa

        for batch in batches:
            x, v = (_unpacked(batch.column(k)) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(((x - v) ** 2).sum(axis=1))], ["q", "node", "d"])

    def measure(pairs: DataFrame) -> DataFrame:
        return pairs.join(short, "node").select("q", "node", "x", "s").mapInArrow(measured, "q long, node long, d double").withColumn("done", F.lit(False))

    def ranked(rows: DataFrame) -> DataFrame:
        # Dealt by query once; merging, ranking and choosing stay there.
        best = rows.repartition("q").groupBy("q", "node").agg(F.min("d").alias("d"), F.max("done").alias("done"))
        best = best.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("d", "node"))).where(F.col("r") <= beam)
        return best.withColumn("turn", F.when(~F.col("done"), F.row_number().over(W.partitionBy("q", "done").orderBy("r")))).drop("r")

    now = stored(ranked(measure(start.select("q", "x", "node"))), "beam")
    while True:
        chosen = now.where(F.col("turn") <= expand)
        if chosen.isEmpty():
            break
        fresh = chosen.join(asked, "q").select("q", "x", F.col("node").alias("a")).join(ways, "a").select("q", "x", F.col("b").alias("node"))
        kept = now.select("q", "node", "d", (F.col("done") | F.coalesce(F.col("turn") <= expand, F.lit(False))).alias("done"))
        after = stored(ranked(kept.unionByName(measure(fresh))), "beam")
        discard(now)
        now = after
    discard(ways, asked)
    return now.select("q", "node", "d")


def nearest(table: DataFrame, every: int = 100, k: int = 10, **settings) -> DataFrame:
    """``query_id, rank, vec_id, score`` for rows whose id is divisible by ``every``.

    Scores are Euclidean distances in double precision; nearest first, ties to the
    smaller id; a row is no neighbour of itself. With fewer than ``k`` other rows all
    are given; an empty table gives none. Rows of equal id and vector are one. Of rows
    with one id and different vectors the least vector (by its bytes) asks, and all are
    candidates of others. Rows with a null id, and vectors that are null, zero, not
    finite or of an uncommon length, take no part. Further columns are not looked at.
    """
    rows = stored(vectors(table), "vectors")
    found = stored(nodes(rows, k + 1), "nodes")
    graph, short = build(found, **settings)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("q")).agg(F.min("v").alias("v"))
    queries = stored(asked.join(found.select("node", "v"), "v").join(short, "node").select("q", "node", "v", F.col("s").alias("x")), "queries")
    near = queries.join(graph.select(F.col("a").alias("node"), "b"), "node").select("q", "x", F.col("b").alias("node"))
    met = search(queries.select("q", "x", "node").union(near), short, graph)

    def exact(batches):
        import pyarrow as pa

        for batch in batches:
            d = ((_matrix(batch.column(1)) - _matrix(batch.column(2))) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d), batch.column(3)], ["q", "d", "ids"])

    met = met.join(found.select("node", F.col("v").alias("w"), "ids"), "node").join(queries.select("q", "v"), "q")
    members = met.select("q", "v", "w", "ids").mapInArrow(exact, "q long, d double, ids array<long>").select("q", "d", F.explode("ids").alias("vec_id")).where("q <> vec_id")
    ranked = members.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("d").alias("score"))
