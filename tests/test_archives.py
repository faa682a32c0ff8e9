"""Archive directories against the standard library, and archives beyond 4 GB."""

import io
import random
import struct
import zipfile

import pytest

from pitchloom.sources import archives, listing


def listed(data: bytes, step: int = 50):
    return list(archives.entries(lambda at, n: data[at : at + n], len(data), step))


def packed(names, comment=b"", front=b""):
    out = io.BytesIO()
    out.write(front)
    with zipfile.ZipFile(out, "a" if front else "w", zipfile.ZIP_DEFLATED) as z:
        for name, size in names:
            z.writestr(name, b"x" * size)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("step", [1, 50, 1 << 20])
@pytest.mark.parametrize("comment", [b"", b"a comment with PK\x05\x06 in it and then some more bytes to follow it"])
def test_entries_equal_the_library(step, comment):
    rnd = random.Random(2)
    names = [(f"dir{k}/Übung-{k}.mp3" if k % 3 else f"plain/{k}.wav", rnd.randrange(3000)) for k in range(300)] + [("folder/", 0)]
    # The library is misled by such a comment, so it lists the archive without it.
    with zipfile.ZipFile(io.BytesIO(packed(names))) as z:
        assert listed(packed(names, comment), step) == [(i.filename, i.file_size, i.compress_size) for i in z.infolist()]


def test_odd_archives():
    assert listed(packed([])) == []
    assert [x[:2] for x in listed(packed([("a", 5)], front=b"#!/bin/sh\n" * 9))] == [("a", 5)]
    for broken in (b"", b"PK", b"no archive at all" * 99, packed([("a", 5)])[:-30]):
        with pytest.raises(archives.NotAnArchive):
            listed(broken)
    whole = packed([("a" * 50, 5)])
    with pytest.raises(archives.NotAnArchive):
        listed(whole.replace(b"PK\x01\x02", b"PK\x01\x09"))


def test_more_entries_than_sixteen_bits():
    data = packed([(str(k), 0) for k in range(66_000)])
    got = listed(data, 1 << 16)
    assert len(got) == 66_000 and got[-1][:2] == ("65999", 0)


def sparse(path, n, size):
    """An archive of ``n`` entries of ``size`` bytes each, as a file with holes: only its directory and ends are written."""
    out, start = b"", n * size
    for k in range(n):
        name = f"concert/song{k}/take.wav".encode()
        wide = struct.pack("<HHQQQ", 1, 24, size, size, k * size)
        out += struct.pack("<4sHHHHHHLLLHHHHHLL", b"PK\x01\x02", 45, 45, 0x800, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + name + wide
    end = struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, len(out), start)
    end += struct.pack("<4sLQL", b"PK\x06\x07", 0, start + len(out), 1)
    end += struct.pack("<4sHHHHLLH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    with open(path, "wb") as f:
        f.seek(start)
        f.write(out + end)


def test_an_archive_of_fifty_gigabytes(spark, tmp_path):
    path = tmp_path / "big.zip"
    sparse(path, 10, 5 << 30)
    assert path.stat().st_size > 50 << 30
    rows = archives.listing(spark, str(path)).collect()
    assert [(r["path"], r["size"]) for r in rows] == [(f"concert/song{k}/take.wav", 5 << 30) for k in range(10)]
    assert listing.archive_entries(archives.listing(spark, str(path))).where("song = 'song3'").count() == 1


def test_a_folder_of_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, files in (("a.zip", [("x.mp3", 9)]), ("in/b.ZIP", [("y.mp3", 8), ("z.mp3", 7)])):
        (tmp_path / name).write_bytes(packed(files))
    (tmp_path / "c.txt").write_bytes(b"no archive")
    rows = archives.listing(spark, f"file://{tmp_path}")
    assert sorted((r["path"], r["size"], r["archive"].rsplit("/", 1)[1]) for r in rows.collect()) == [("x.mp3", 9, "a.zip"), ("y.mp3", 8, "b.ZIP"), ("z.mp3", 7, "b.ZIP")]
