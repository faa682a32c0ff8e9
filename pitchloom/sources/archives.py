"""Listings of zip archives of any size: a data source that reads their directories only.

The end record is sought in an archive's last bytes; it tells where the central directory
is, in archives beyond 4 GB or 65,535 entries by way of the ZIP64 records. The directory is
then read a stretch at a time. No other byte of the archive is read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pitchloom.shipping import known_to_workers

#: The end record has 22 bytes and a comment of at most 65,535.
TAIL = 22 + 65_535
STEP = 1 << 20
SCHEMA = "path string, size long, compressed long, archive string"


class NotAnArchive(ValueError):
    pass


def directory(read: Callable[[int, int], bytes], length: int) -> tuple[int, int, int]:
    """Where the central directory begins, how many bytes it has, and how many entries.

    ``read`` gives so many bytes from an offset. Archives with bytes put in front of them
    are understood: offsets count from the directory's true place.
    """
    start = max(0, length - TAIL)
    tail = read(start, length - start)
    at = tail.rfind(b"PK\x05\x06")
    # The comment behind the record ends the archive; the same mark may stand in it.
    while at >= 0 and (len(tail) < at + 22 or len(tail) != at + 22 + struct.unpack_from("<H", tail, at + 20)[0]):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise NotAnArchive("no end record")
    entries, size, offset = struct.unpack_from("<HLL", tail, at + 10)
    end = start + at
    if (0xFFFF == entries or 0xFFFFFFFF in (size, offset)) and end >= 20:
        mark, _, wide, _ = struct.unpack("<4sLQL", read(end - 20, 20))
        if mark == b"PK\x06\x07":
            record = read(wide, 56)
            if record[:4] != b"PK\x06\x06":  # bytes in front: the record stands right before its locator
                wide = end - 20 - 56
                record = read(wide, 56)
            if record[:4] != b"PK\x06\x06":
                raise NotAnArchive("no ZIP64 end record")
            entries, size, offset = struct.unpack_from("<QQQ", record, 32)
            end = wide
    return end - size, size, entries


def entries(read: Callable[[int, int], bytes], length: int, step: int = STEP) -> Iterator[tuple[str, int, int]]:
    """``path, size, compressed`` of every entry, in the directory's order."""
    at, size, _ = directory(read, length)
    held, end = b"", at + size
    while at < end or held:
        if at < end and len(held) < 3 * 65_535 + 46:
            more = read(at, min(step, end - at))
            if not more:
                raise NotAnArchive("the directory is cut off")
            at += len(more)
            held += more
        place = 0
        while len(held) - place >= 46 and (at == end or len(held) - place >= 3 * 65_535 + 46):
            mark, flags, packed, plain = struct.unpack_from("<4s4xH10xLL", held, place)
            if mark != b"PK\x01\x02":
                raise NotAnArchive("no entry where one is due")
            name, extra, comment = struct.unpack_from("<HHH", held, place + 28)
            raw = held[place + 46 : place + 46 + name]
            rest, k = held[place + 46 + name : place + 46 + name + extra], 0
            while k + 4 <= len(rest):
                kind, n = struct.unpack_from("<HH", rest, k)
                if kind == 1:  # the wide fields, in this order, of those that do not fit
                    wide = k + 4
                    if plain == 0xFFFFFFFF:
                        (plain,), wide = struct.unpack_from("<Q", rest, wide), wide + 8
                    if packed == 0xFFFFFFFF:
                        (packed,) = struct.unpack_from("<Q", rest, wide)
                k += 4 + n
            yield raw.decode("utf-8" if flags & 0x800 else "cp437", "replace"), plain, packed
            place += 46 + name + extra + comment
        held = held[place:]
        if at == end and 0 < len(held) < 46:
            raise NotAnArchive("the directory is cut off")


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri or uri.startswith("/") else (fs.LocalFileSystem(), uri)


class _Archive(InputPartition):
    def __init__(self, uri: str, path: str):
        self.uri, self.path = uri, path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.step = options["path"], int(options.get("step", STEP))

    def partitions(self):
        from pyarrow import fs

        system, path = _opened(self.root)
        told = system.get_file_info(path)
        if told.type == fs.FileType.File:
            return [_Archive(self.root, path)]
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return [_Archive(self.root, x.path) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.path.lower().endswith(".zip")]

    def read(self, partition):
        system, _ = _opened(partition.uri)
        with system.open_input_file(partition.path) as f:
            for name, size, packed in entries(lambda at, n: f.read_at(n, at), f.size(), self.step):
                yield name, size, packed, partition.path


class ZipDirectories(DataSource):
    """``path, size, compressed, archive`` of the entries of one zip file, or of all below a folder; a task an archive."""

    @classmethod
    def name(cls):
        return "zip_directories"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the zip archives at ``path``: a file or folder, local or of a store that Arrow reads (a URI)."""
    known_to_workers(spark)
    spark.dataSource.register(ZipDirectories)
    return spark.read.format("zip_directories").load(path)


def written(files: Iterator[tuple[str, int]], out, directory) -> int:
    """Write a zip archive of ``path, size`` files of zero bytes to ``out``; how many there were.

    The central directory is collected in the file ``directory`` and copied at the end, so
    that memory does not grow with the entries. ZIP64 records follow where numbers need them.
    """
    import zlib

    n = at = 0
    for path, size in files:
        name, pack, crc, packed = path.encode(), zlib.compressobj(wbits=-15), 0, []
        for k in range(0, size, STEP):
            piece = bytes(min(STEP, size - k))
            crc = zlib.crc32(piece, crc)
            packed.append(pack.compress(piece))
        body = b"".join([*packed, pack.flush()])
        wide = 0xFFFFFFFF
        # Name in UTF-8, deflated, 1 January 1980.
        common = struct.pack("<HHHHHL", 45, 0x800, 8, 0, 33, crc)
        big = size >= wide or len(body) >= wide
        own = struct.pack("<HHQQ", 1, 16, size, len(body)) if big else b""
        head = b"PK\x03\x04" + common + struct.pack("<LLHH", wide if big else len(body), wide if big else size, len(name), len(own)) + name + own
        more = [x for x, needed in ((size, big), (len(body), big), (at, at >= wide)) if needed]
        extra = struct.pack(f"<HH{len(more)}Q", 1, 8 * len(more), *more) if more else b""
        directory.write(b"PK\x01\x02" + struct.pack("<H", 45) + common + struct.pack("<LLHHHHHLL", wide if big else len(body), wide if big else size, len(name), len(extra), 0, 0, 0, 0, min(at, wide)) + name + extra)
        out.write(head)
        out.write(body)
        at, n = at + len(head) + len(body), n + 1
    length = directory.tell()
    directory.seek(0)
    while piece := directory.read(STEP):
        out.write(piece)
    if n >= 0xFFFF or max(at, length) >= 0xFFFFFFFF:
        out.write(struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, length, at) + struct.pack("<4sLQL", b"PK\x06\x07", 0, at + length, 1))
    out.write(struct.pack("<4sHHHHLLH", b"PK\x05\x06", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(length, 0xFFFFFFFF), min(at, 0xFFFFFFFF), 0))
    return n


def write(files: DataFrame, path: str) -> None:
    """Zip archives below ``path`` from ``path, size, archive`` rows: files of so many zero bytes, an archive for each number.

    For tests and rehearsals of what reads archives. An archive is written by one task, as
    its rows come; its directory is held in a temporary file until then.
    """
    import pyarrow as pa

    def one(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tempfile

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path) if ":/" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
        system.create_dir(root, recursive=True)
        number = key[0].as_py()
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        # A task that is run again writes the same file.
        with system.open_output_stream(f"{root}/{number}.zip", buffer_size=STEP) as f, tempfile.TemporaryFile() as held:
            n = written(rows, f, held)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([n], pa.int64())], ["archive", "n"])

    # Spark tells the iterator's form by the hints themselves, not by their text.
    one.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    rows = files.select("path", F.col("size").cast("long").alias("size"), F.col("archive").cast("long").alias("archive"))
    rows.groupBy("archive").applyInArrow(one, "archive long, n long").collect()  # a row for each archive
