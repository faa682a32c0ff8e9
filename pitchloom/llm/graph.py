"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.llm import tokens
from pitchloom.llm.common import discard, stored


class Forest:
    """Union-find over any hashable nodes; the least node is the root."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        path = []
        while (above := self.up.get(x, x)) != x:
            path.append(x)
            x = above
        for y in path:
            self.up[y] = x
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        if y < x:
            x, y = y, x
        self.up[y] = x
        return True


def _within(edges: DataFrame) -> DataFrame:
    """Each partition's edges replaced by an edge from each node to the least node it reaches there."""

    def run(batches):
        import pyarrow as pa

        forest, nodes = Forest(), set()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(a, b)
                nodes.update((a, b))
        pairs = [(x, r) for x in nodes if (r := forest.root(x)) != x]
        a, b = zip(*pairs) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return edges.mapInArrow(tokens.gives_back(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` rows (longs): the least node it is connected to.

    Large-star and small-star rounds, after each task has contracted its own edges.
    A round costs a few shuffles of the edges, whose number does not grow; the
    rounds are logarithmic in the longest path. Rounds end when the edges, told by
    their number and the sum of their hashes, no longer change. The result reads a table
    that :func:`~pitchloom.llm.common.discard` deletes.
    """
    now = stored(_within(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")).distinct(), "edges")
    mark = None
    while True:
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()
        if not found["n"] or tuple(found) == mark:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._stored_at = now._stored_at
            return out
        mark = tuple(found)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = stored(small, "edges")
        discard(now)
        now = after
