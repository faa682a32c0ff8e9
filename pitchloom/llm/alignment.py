"""Alignment of two tokenizers' tokens over the bytes of the same texts.

A (a byte-level vocabulary of the tokenizers library) and B (a sentencepiece model)
encode a space and the text. Where tokens of both end, the text is cut into groups; an
A and a B token whose bytes overlap are linked. How often a pair of ids is linked in the
whole corpus tells which A id is a B id's best partner.

All of a slice of texts is aligned at once with NumPy: ``cumsum`` of the tokens' bytes
gives their ends, ``intersect1d`` the common cuts, ``searchsorted`` each token's group and
the first and last partner, and ``repeat`` expands the links. Nothing loops over tokens.

1. :func:`aligned` writes a table with each text's ids and counts, and every task's tally
   of linked pairs.
2. :func:`pair_counts` sums the tallies in two shuffles, the first one by pair and salt.
3. :func:`digests` reads the ids back and adds up the counts of each text's links. The
   table of pairs (at most one for every two ids of the vocabularies) is broadcast in
   blocks of at most ``BLOCK`` pairs; sums over several blocks are added up.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.llm import shingles, tokens
from pitchloom.llm.common import discard, id_text, stored

#: Pairs of ids in a broadcast block; 17 bytes each in every worker.
BLOCK = 4 << 20
#: Distinct pairs that a task tallies before it hands them on.
TALLY = 1 << 20
#: Salts of the first sum.
SALTS = 16
#: Bytes of text that are aligned at once.
SLICE = 2 << 20
#: Bytes that a worker spends on the words it knows, for each tokenizer.
ROOM = 64 << 20

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary, pairs array<long>, counts array<long>"


#: White space beside white space, or beyond ASCII: such texts are encoded whole.
_ODD = re.compile(rb"[\t-\r ][\t-\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[ \n]\Z")
#: Behind a letter of ASCII or of U+00C0 to U+017F.
_LETTER = rb"(?:(?<=[A-Za-z])|(?<=[\xc3-\xc5][\x80-\xbf])(?<!\xc3[\x97\xb7]))"
_SIGNS = ".,;:!?"


_PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3(?![\x97\xb7])[\x80-\xbf]|\xc4(?!\xb0)[\x80-\xbf]|\xc5[\x80-\xbf])+").fullmatch


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Pieces:
    """Ids by a sentencepiece model that puts a space before the text.

    No merge crosses a place between two characters that stand side by side in no piece,
    so that a text may be cut there. ``signs`` are those before which it may be cut behind
    a letter; ``cuts`` tells that it may be cut before spaces and around line ends as well.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        beside = {(x, y) for k in range(self.model.vocab_size()) for name in [self.model.id_to_piece(k)] if not self.model.is_byte(k) for x, y in zip(name, name[1:])}
        self.signs = "".join(y for y in _SIGNS if not any(b == y and a.isalpha() for a, b in beside))
        self.cuts = not any((x != "▁" and y == "▁") or "\n" in (x, y) for x, y in beside) and self.model.encode("a b") == self.model.encode("a") + self.model.encode("b") and len(self.model.encode("\n")) == 2

    def whole(self, text: bytes) -> bytes:
        return np.array(self.model.encode(text.decode("utf-8", "replace")), "<u4").tobytes()

    def chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks of cut texts. One without its space goes behind a line end, whose two ids are left out."""
        found = self.model.encode([(c[1:] if c[:1] == b" " else b"\n" + c).decode("utf-8", "replace") for c in chunks], num_threads=1)
        return [_packed(ids if c[:1] == b" " else ids[2:]) for c, ids in zip(chunks, found)]


class Known(dict):
    """Chunk -> ids, up to ``room`` bytes; ``extra`` holds what found no room, for one slice of texts."""

    def __init__(self, room: int):
        super().__init__()
        self.room, self.extra = room, {}

    def __missing__(self, chunk: bytes) -> bytes:
        return self.extra[chunk]

    def learn(self, chunks: list[bytes], ids: list[bytes]) -> None:
        for chunk, x in zip(chunks, ids):
            size = len(chunk) + len(x) + tokens.ENTRY
            if size <= self.room:
                self.room -= size
                self[chunk] = x
            else:
                self.extra[chunk] = x


def _piece_bytes(model, k: int) -> bytes:
    name = model.id_to_piece(k)
    return bytes([int(name[3:5], 16)]) if model.is_byte(k) else name.replace("▁", " ").encode()


class _Table:
    """The bytes of every id, end to end."""

    def __init__(self, all_: list[bytes]):
        self.size = np.array([len(x) for x in all_], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(all_), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        behind = np.cumsum(size)
        return self.flat[np.repeat(self.at[ids] - behind + size, size) + np.arange(behind[-1] if len(behind) else 0)]


class Aligner:
    """Both tokenizers of a worker, and the bytes of their ids."""

    def __init__(self, a: str, b: str):
        tokens.check_split(a, "space")
        library = tokens.library(a)
        library.encode_special_tokens = True
        model = library.model
        self.a = tokens.TextEncoder("space", (), lambda piece: [t.id for t in model.tokenize(tokens.spelled(piece))], lambda text: library.encode(text, add_special_tokens=False).ids, chunks=0)
        byte = dict(enumerate(tokens.byte_letters()))
        # Letters, with a space or without, are one piece of the split.
        self.word = lambda c: _packed([t.id for t in model.tokenize(c.decode("latin-1").translate(byte))])
        self.b = Pieces(b)
        self.split = re.compile(rb"(?= )|(?=\n)|(?<=\n)|" + _LETTER + rb"(?=[" + self.b.signs.encode() + rb"])" if self.b.signs else rb"(?= )|(?=\n)|(?<=\n)").split if self.b.cuts else None
        self.known_a, self.known_b = Known(ROOM), Known(ROOM)
        back = {c: k for k, c in enumerate(tokens.byte_letters())}
        letters = [library.id_to_token(k) or "" for k in range(library.get_vocab_size(with_added_tokens=True))]
        # Special tokens are not in the alphabet of bytes; no text gives them.
        self.a_bytes = _Table([bytes(back[c] for c in x) if all(c in back for c in x) else b"" for x in letters])
        self.b_bytes = _Table([_piece_bytes(self.b.model, k) for k in range(self.b.model.vocab_size())])

    def encode(self, texts: list[bytes | None]) -> tuple[list[bytes], list[bytes]]:
        """Ids of every text by A and by B; none for texts whose ids do not give their bytes back."""
        a, b = [b""] * len(texts), [b""] * len(texts)
        cut: dict[int, list[bytes]] = {}
        for k, text in enumerate(texts):
            if not text:
                continue
            if self.split is None or text[:1] in b" \n" or _ODD.search(text):
                a[k], b[k] = self.a(b" " + text), self.b.whole(text)
            else:
                cut[k] = self.split(b" " + text)
        # Words that a worker does not know are encoded once a slice.
        new = list(set().union(*cut.values()) - self.known_a.keys() - {b""})
        self.known_a.extra, self.known_b.extra = {b"": b""}, {b"": b""}
        self.known_a.learn(new, [self.word(c) if _PLAIN(c) else self.a.chunks.encode(c.decode("utf-8", "replace")) for c in new])
        self.known_b.learn(new, self.b.chunks(new))
        for k, chunks in cut.items():
            a[k], b[k] = b"".join(map(self.known_a.__getitem__, chunks)), b"".join(map(self.known_b.__getitem__, chunks))
        expected = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        good = np.ones(len(texts), bool)
        for table, ids in ((self.a_bytes, a), (self.b_bytes, b)):
            flat, n = np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) >> 2 for x in ids], np.int64)
            good &= _sums(table.size[flat], n) == expected
        kept = np.flatnonzero(good)
        want = np.frombuffer(b"".join([b" " + texts[k] for k in kept if texts[k]]), np.uint8)
        ends = np.cumsum(expected[kept])
        for table, ids in ((self.a_bytes, a), (self.b_bytes, b)):
            same = table.joined(np.frombuffer(b"".join([ids[k] for k in kept]), "<u4")) == want
            if not same.all():
                good[kept[np.searchsorted(ends, np.flatnonzero(~same), side="right")]] = False
        return [x if g else b"" for x, g in zip(a, good)], [x if g else b"" for x, g in zip(b, good)]


@lru_cache(1)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of an array of integers."""
    total = np.append(np.int64(0), np.cumsum(values, dtype=np.int64))
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


class Links:
    """Groups and links of the tokens of many texts, laid end to end.

    ``a``, ``b``: ids; ``n_a``, ``n_b``: tokens of each text, whose bytes agree.
    """

    def __init__(self, both: Aligner, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        size_a = both.a_bytes.size[a]
        end_a, end_b = np.cumsum(size_a), np.cumsum(both.b_bytes.size[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        bytes_ = np.append(np.int64(0), end_a)[np.cumsum(n_a)]
        self.n_groups = np.diff(np.searchsorted(cuts, bytes_, side="right"), prepend=0)
        first = np.searchsorted(end_b, end_a - size_a, side="right")
        partners = np.searchsorted(end_b, end_a) - first + 1
        behind = np.cumsum(partners)
        # Links in the order of their A tokens: the A token, and the B token.
        self.link_a = np.repeat(np.arange(len(a)), partners)
        self.link_b = np.arange(len(self.link_a)) + np.repeat(first - behind + partners, partners)
        self.n_links = _sums(partners, n_a)

    def pairs(self, size_b: int) -> np.ndarray:
        """A number for the two ids of every link."""
        return self.a[self.link_a].astype(np.int64) * size_b + self.b[self.link_b]

    def written(self) -> list[bytes]:
        """Each text's groups: ids of A, a bar, ids of B; groups apart by semicolons."""
        n = len(self.a) + len(self.b)
        last_a = np.append(self.group_a[1:] != self.group_a[:-1], True)[: len(self.a)]
        last_b = np.append(self.group_b[1:] != self.group_b[:-1], True)[: len(self.b)]
        at_a = np.arange(len(self.a)) + np.searchsorted(self.group_b, self.group_a)
        at_b = np.arange(len(self.b)) + np.searchsorted(self.group_a, self.group_b, side="right")
        ids, sign = np.zeros(n, np.int64), np.zeros(n, np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        sign[at_a], sign[at_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        digits = 1 + np.searchsorted(10 ** np.arange(1, 10), ids, side="right")
        wide = int(digits.max(initial=1))
        shown = np.zeros((n, wide + 1), np.uint8)
        for k in range(wide):
            shown[:, k] = ids // 10 ** (wide - 1 - k) % 10 + 48
        shown[:, wide] = sign
        flat = shown[np.arange(wide + 1) >= wide - digits[:, None]]
        ends = np.append(0, np.cumsum(digits + 1))[np.cumsum(self.n_a + self.n_b)].tolist()
        whole = flat.tobytes()
        return [whole[x : y - 1] if y > x else b"" for x, y in zip([0, *ends[:-1]], ends)]


class _Tally:
    """Counts of pairs, merged now and then."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, pairs: np.ndarray) -> None:
        if len(pairs):
            self.parts.append(np.unique(pairs, return_counts=True))
            self.held += len(self.parts[-1][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            keys, counts = (np.concatenate(x) for x in zip(*self.parts))
            distinct, where = np.unique(keys, return_inverse=True)
            sums = np.zeros(len(distinct), np.int64)
            np.add.at(sums, where, counts)
            self.parts = [(distinct, sums)]
        keys, counts = self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.held = len(keys)
        return keys, counts

    def clear(self) -> None:
        self.parts, self.held = [], 0


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A stored table of one row per document, and of rows that hold only tallies (``pairs``, ``counts``)."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        both = aligner(a, b)
        size_b = len(both.b_bytes.size)
        tally, row = _Tally(), TaskContext.get().partitionId() << 36
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

        def tallied():
            keys, counts = tally.merged()
            tally.clear()
            cells = [pa.nulls(1, f.type) for f in schema]
            return pa.RecordBatch.from_arrays([*cells[:-2], pa.array([keys], schema.field("pairs").type), pa.array([counts], schema.field("counts").type)], schema=schema)

        for batch in batches:
            for part in shingles.slices(batch, 1, SLICE):
                ids_a, ids_b = both.encode(part.column(1).cast(pa.binary()).to_pylist())
                n_a, n_b = (np.array([len(x) >> 2 for x in ids], np.int64) for ids in (ids_a, ids_b))
                links = Links(both, np.frombuffer(b"".join(ids_a), "<u4"), np.frombuffer(b"".join(ids_b), "<u4"), n_a, n_b)
                tally.add(links.pairs(size_b))
                digest = [hashlib.sha256(x).hexdigest() if x else "" for x in links.written()]
                numbers = [np.arange(row, row + part.num_rows), part.column(0), n_a, n_b, links.n_groups, links.n_links]
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in numbers], pa.array(digest, pa.string()), pa.array(_narrow(ids_a), pa.binary()), pa.array(_narrow(ids_b), pa.binary()), *[pa.nulls(part.num_rows, schema.field(k).type) for k in ("pairs", "counts")]], schema=schema)
                if tally.held > 4 * TALLY:
                    tally.merged()
                if tally.held > TALLY and len(tally.parts) == 1:
                    yield tallied()
        if tally.parts:
            yield tallied()

    return stored(id_text(docs).mapInArrow(run, ALIGNED), "aligned")


def _narrow(ids: list[bytes]) -> list[bytes]:
    """Ids as planes of their low and high halves: the high ones are zeros that the file packs away."""
    out = []
    for x in ids:
        halves = np.frombuffer(x, "<u2")
        out.append(halves[::2].tobytes() + (halves[1::2].tobytes() if halves[1::2].any() else b""))
    return out


def _wide(column, n: np.ndarray) -> np.ndarray:
    """Ids of many texts; ``n``: how many each has."""
    parts = []
    for x, size in zip(column, n.tolist()):
        halves = np.frombuffer(x.as_buffer(), "<u2").astype(np.uint32)
        parts.append(halves if len(halves) == size else halves[:size] | halves[size:] << np.uint32(16))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def pair_counts(table: DataFrame, size_b: int) -> DataFrame:
    """``pair, count, best`` for every linked pair of ids; ``best``: no other pair of its B id is linked more often."""
    each = table.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    salted = each.groupBy("pair", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    counts = salted.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.pmod("pair", F.lit(size_b)))
    # No more rows than B has ids.
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _scored(texts: DataFrame, known, a: str, b: str) -> DataFrame:
    """``texts`` with ``n_best`` and ``count_sum`` over the pairs of a broadcast block."""

    def run(batches):
        import pyarrow as pa

        both = aligner(a, b)
        keys, counts, best = known.value
        for batch in batches:
            for part in shingles.slices(batch, 7, SLICE):
                n_a, n_b = np.asarray(part.column(2)), np.asarray(part.column(3))
                links = Links(both, _wide(part.column(7), n_a), _wide(part.column(8), n_b), n_a, n_b)
                pairs = links.pairs(len(both.b_bytes.size))
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                    met = keys[at] == pairs
                    sums = [_sums(np.where(met, x[at], 0), links.n_links) for x in (best, counts)]
                else:
                    sums = [np.zeros(part.num_rows, np.int64)] * 2
                yield pa.RecordBatch.from_arrays([*part.columns[:7], *[pa.array(x, pa.int64()) for x in sums]], names=[*part.schema.names[:7], "n_best", "count_sum"])

    columns = ALIGNED.split(", ")
    return texts.select(*[c.split()[0] for c in columns[:9]]).mapInArrow(run, ", ".join(columns[:7]) + ", n_best long, count_sum long")


def digests(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row.

    Strings of special tokens are plain text. A text that is null or empty, or whose
    tokens' bytes by A or by B are not a space and the text, has no tokens: zeros and an
    empty ``groups_sha256``. Every row of ``docs`` gives a row; null and repeated ids, and
    repeated rows (each counts), are no exception. A long text is aligned as one slice. An
    empty table gives an empty one. Further columns are left out, whatever their names.
    """
    table = aligned(docs, a, b)
    spark = docs.sparkSession
    counts = stored(pair_counts(table, aligner(a, b).b.model.vocab_size()), "pairs")
    n = counts.count()
    blocks = max(1, -(-n // BLOCK))
    texts = table.where("row is not null")
    out = None
    for k in range(blocks):
        block = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k) if blocks > 1 else counts
        columns = block.orderBy("pair").toArrow()  # about BLOCK rows
        known = spark.sparkContext.broadcast((np.asarray(columns.column("pair")), np.asarray(columns.column("count")), np.asarray(columns.column("best")).astype(np.int8)))
        scored = _scored(texts, known, a, b)
        out = scored if out is None else out.unionByName(scored)
    if blocks > 1:
        out = out.groupBy(*ALIGNED.replace(" long", "").replace(" string", "").split(", ")[:7]).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    discard(counts)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def translations(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``b, a, count``: each B id's most linked A ids (ties: all of them), a map from one vocabulary to the other."""
    table = aligned(docs, a, b)
    size = aligner(a, b).b.model.vocab_size()
    return pair_counts(table, size).where("best").select(F.pmod("pair", F.lit(size)).cast("int").alias("b"), F.floor(F.col("pair") / size).cast("int").alias("a"), "count")
