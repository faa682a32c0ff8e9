"""Token-id files of patched frame-of-reference blocks.

A file is a folder of Parquet rows, one per segment, so that Spark's committer
makes writes atomic and any store can hold them. A segment has whole documents
in ascending ``doc_id`` order and a ``payload``:

    magic "PFB1", n_ids, n_blocks, n_exceptions    4 x unsigned 32 bit
    start of each block's packed bits in the body  n_blocks x unsigned 32 bit
    first exception of each block                  n_blocks x unsigned 32 bit
    block minimum                                  n_blocks x unsigned 32 bit
    block width in bits                            n_blocks x unsigned 8 bit
    exceptions: place in block                     n_exceptions x unsigned 8 bit
    exceptions: value less the minimum             n_exceptions x unsigned 32 bit
    body: the packed blocks

All integers are little-endian. A block has 128 values. Its width is the least
that holds ``percentile`` of the values less the minimum; values that need more
bits keep their low bits in the body and are listed whole as exceptions. The
last block is filled up with its minimum. The packed bits of a block are planes:
the lowest bit of all its values, then the next, and so on.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitchloom.llm import shingles, tokens
from pitchloom.llm.common import id_text, partitions

BLOCK = 128
MAGIC = int.from_bytes(b"PFB1", "little")
SEGMENT = 1 << 18
#: Bytes that a worker spends on words here; byte-level chunks are many.
CHUNKS, PIECES = 160 << 20, 60 << 20

FILE = "shard int, shard_start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


_NEED = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    if not len(x) or x.max() < 1 << 16:
        return _NEED[x]
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """A segment's payload."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.empty(blocks * BLOCK, np.uint32)
    grid[:n] = ids
    if n % BLOCK:
        grid[n:] = ids[(blocks - 1) * BLOCK :].min()
    grid = grid.reshape(blocks, BLOCK)
    least = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    grid = grid - least[:, None]
    need = _bits(grid)
    over = BLOCK - min(BLOCK, max(1, int(np.ceil(percentile * BLOCK))))
    width, turned = np.zeros(blocks, np.uint8), np.ascontiguousarray(need.T)
    for k in range(int(need.max(initial=0))):
        width += (turned > k).sum(axis=0, dtype=np.uint8) > over
    row, col = np.divmod(np.flatnonzero(need > width[:, None]), BLOCK)
    first = np.searchsorted(row, np.arange(blocks)).astype("<u4")
    size = width.astype(np.uint32) * (BLOCK // 8)
    start = np.zeros(blocks, "<u4")
    start[1:] = np.cumsum(size)[:-1]
    body = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width).tolist():
        if w:
            own = np.flatnonzero(width == w)
            kind = "<u2" if w <= 16 else "<u4"
            low = grid[own].astype(kind)
            planes = np.stack([np.packbits((low & (1 << k)) != 0, axis=1, bitorder="little") for k in range(w)], axis=1)
            body[start[own][:, None] + np.arange(BLOCK // 8 * w, dtype=np.uint32)] = planes.reshape(len(own), -1)
    head = np.array([MAGIC, n, blocks, len(row)], "<u4")
    return b"".join([head.tobytes(), start.tobytes(), first.tobytes(), least.astype("<u4").tobytes(), width.tobytes(), col.astype(np.uint8).tobytes(), grid[row, col].astype("<u4").tobytes(), body.tobytes()])


def unpack(payload: bytes, block: int | None = None) -> np.ndarray:
    """The ids of a payload, or of one of its blocks (found by its start in the index)."""
    magic, n, blocks, patches = np.frombuffer(payload, "<u4", 4).tolist()
    if magic != MAGIC:
        raise ValueError("not a payload of this format")
    start, first, least = np.frombuffer(payload, "<u4", 3 * blocks, 16).reshape(3, blocks)
    at = 16 + 12 * blocks
    width = np.frombuffer(payload, np.uint8, blocks, at)
    col = np.frombuffer(payload, np.uint8, patches, at + blocks)
    value = np.frombuffer(payload, "<u4", patches, at + blocks + patches)
    body = np.frombuffer(payload, np.uint8, -1, at + blocks + 5 * patches)
    if block is not None:
        chosen = np.array([block])
        lo, hi = int(first[block]), int(first[block + 1]) if block + 1 < blocks else patches
    else:
        chosen, lo, hi = np.arange(blocks), 0, patches
    grid = np.zeros((len(chosen), BLOCK), np.uint32)
    for w in np.unique(width[chosen]).tolist():
        if w:
            own = np.flatnonzero(width[chosen] == w)
            raw = body[start[chosen[own]][:, None] + np.arange(BLOCK // 8 * w, dtype=np.uint32)]
            kind = np.dtype("<u2" if w <= 16 else "<u4")
            planes, low = raw.reshape(len(own), w, -1), np.zeros((len(own), BLOCK), kind)
            for k in range(w):
                low |= np.unpackbits(planes[:, k], axis=1, bitorder="little").astype(kind) << kind.type(k)
            grid[own] = low
    row = np.searchsorted(first, np.arange(lo, hi), side="right") - 1 - (block or 0)
    grid[row, col[lo:hi]] = value[lo:hi]
    out = (grid + least[chosen][:, None]).ravel()
    return out[:n] if block is None else out[: n - block * BLOCK]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, percentile: float = 0.9, shards: int | None = None) -> None:
    """Encode every whole text and write the ids, in ascending ``doc_id`` order, to ``path``.

    The texts are dealt by ranges of ``doc_id`` into ``shards`` tasks (default: the
    session's shuffle partitions), encoded there by the tokenizers library and
    packed as they come: neither ids nor texts are collected beyond a segment of
    at least ``SEGMENT`` ids. A null text is empty and gets the end id alone; a
    null ``doc_id`` sorts first; rows with equal ids are kept, in any order. An
    empty table makes an empty file.
    """
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, done = TaskContext.get().partitionId(), 0
        encoder = tokens.library_encoder(vocabulary, "space", CHUNKS, PIECES)
        names, sizes, parts, held = [], [], [], 0

        def segment():
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([done], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([pack(ids, percentile)], pa.binary())],
                ["shard", "shard_start", "n_ids", "doc_ids", "lengths", "payload"],
            )

        for batch in batches:
            for part in shingles.slices(batch, 1):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    parts.append(encoder(text or b"") + end)
                    names.append(doc_id)
                    sizes.append(len(parts[-1]) // 4)
                    held += sizes[-1]
                    if held >= SEGMENT:
                        yield segment()
                        done += held
                        names, sizes, parts, held = [], [], [], 0
        if names:
            yield segment()

    dealt = id_text(docs).repartitionByRange(shards or partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(run, FILE).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` of a file, ids as unsigned 32-bit bytes."""
    return _documents(spark, path, "ids binary", lambda ids: ids)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of a file."""
    return _documents(spark, path, "n_tokens long, ids_crc32 long", lambda ids: (len(ids) // 4, zlib.crc32(ids)))


def _documents(spark: SparkSession, path: str, columns: str, of) -> DataFrame:
    """A row per document: its id, the ids of all documents before it, and ``of`` its ids' bytes."""
    names = [c.split()[0] for c in columns.split(", ")]
    schema = f"doc_id long, shard int, place long, {columns}"

    def run(batches):
        import pandas as pd
        import pyarrow as pa

        for batch in batches:
            for shard, begin, _, docs, lengths, payload in zip(*(c.to_pylist() for c in batch.columns)):
                ids = unpack(payload).astype("<u4", copy=False)
                stops = np.cumsum(np.array(lengths, np.int64))
                values = [of(ids[b - n : b].tobytes()) for b, n in zip(stops.tolist(), lengths)]
                columns = {"doc_id": pd.array(docs, "Int64"), "shard": np.int32(shard), "place": begin + stops - np.array(lengths, np.int64)}
                columns |= {name: [v[k] if isinstance(v, tuple) else v for v in values] for k, name in enumerate(names)}
                yield pa.RecordBatch.from_pandas(pd.DataFrame(columns), preserve_index=False)

    file = spark.read.schema(FILE).parquet(path)
    # One row per shard, so at most as many as the writer had tasks.
    sizes = file.groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_ids")).alias("n"))
    bases = sizes.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))
    rows = file.select(*[c.split()[0] for c in FILE.split(", ")]).mapInArrow(run, schema)
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), *names)
