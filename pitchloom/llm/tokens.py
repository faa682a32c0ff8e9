"""Whole-text token ids by cached chunks.

Both tokenizers used here split a text before any merge is applied, and no
piece of that split crosses certain blanks. A text therefore equals the
concatenation of independently encoded chunks, and each worker remembers the
chunks it has met. The memory is bounded in bytes: a full cache stops growing.

``split_at`` says where a text may be cut:

* ``"blank"``: at any ASCII white space, which the tokenizer drops;
* ``"space"``: before a space that follows no other space. The space stays with
  the chunk behind it. A text with two spaces in a row is encoded as one chunk.

Where the texts are cut at blanks, :class:`ColumnEncoder` takes whole columns of
them: NumPy finds the pieces, Arrow tells which are equal, and each different
piece is looked up once.
"""

from __future__ import annotations

import ctypes
import json
import re
import sys
from collections.abc import Callable
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np

from pitchloom.llm import shingles

#: Bytes that a worker spends on chunks and on pieces; an entry counts with its own size and ``ENTRY`` for the table and the objects.
CHUNKS, PIECES, ENTRY = 56 << 20, 20 << 20, 190
#: The same for whole columns: unusual chunks, and pieces in arrays. Bytes of text that are split at once.
COLUMN_CHUNKS, COLUMN_PIECES, WINDOW = 16 << 20, 16 << 20, 2 << 20

# The published split patterns of the two vocabularies, restricted
# to ASCII and the letters U+00C0 to U+017F without U+0130.
_LOW = "a-zß-öø-įı-ſ"
_ANY = "A-Za-zÀ-ÖØ-öø-įı-ſ"
WORD_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOW}]+|[0-9]|[^\s{_LOW}0-9]+")
BYTE_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_ANY}]+| ?[0-9]+| ?[^\s{_ANY}0-9]+|\s+(?!\S)|\s+")
PLAIN = re.compile(rf"[\t-\r\x20-\x7e{_ANY}]*")


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


@lru_cache(1)
def _spelling() -> dict[int, str]:
    return dict(enumerate(byte_letters()))


def spelled(piece: str) -> str:
    """A piece in the alphabet of byte-level vocabularies."""
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_spelling())


class Pieces(dict):
    """Piece -> ids as little-endian unsigned 32-bit bytes, computed when first asked for."""

    def __init__(self, ids_of: Callable[[str], list[int]], room: int):
        super().__init__()
        self.ids_of, self.room = ids_of, room

    def __missing__(self, piece: str) -> bytes:
        ids = self.ids_of(piece)
        out = pack(f"<{len(ids)}I", *ids)
        size = len(piece) + len(out) + ENTRY
        if size <= self.room:
            self.room -= size
            self[piece] = out
        return out


class Chunks(dict):
    """Chunk (UTF-8) -> ids as bytes.

    ``piece_ids`` encodes one piece of the split; ``whole_ids`` encodes any chunk
    and serves those with unusual characters or with a special token's string.
    """

    def __init__(self, pattern: re.Pattern, lower: bool, lead: str, special: tuple[str, ...], piece_ids, whole_ids, chunks: int, pieces: int):
        super().__init__()
        self.room = chunks
        self.pattern, self.lower, self.lead, self.whole_ids = pattern, lower, lead, whole_ids
        self.plain, self.has_special = PLAIN.fullmatch, re.compile("|".join(map(re.escape, special)) or "(?!)").search
        self.special = [x.encode() for x in special]
        self.pieces = Pieces(piece_ids, pieces)

    def encode(self, chunk: str) -> bytes:
        if self.plain(chunk) and not self.has_special(chunk):
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk.lower() if self.lower else chunk)))
        return np.array(self.whole_ids(chunk), dtype="<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        out = self.encode(self.lead + chunk.decode("utf-8", "replace"))
        size = len(chunk) + len(out) + ENTRY
        if size <= self.room:
            self.room -= size
            self[chunk] = out
        return out


class TextEncoder:
    """Texts (UTF-8 bytes) to ids (bytes of unsigned 32-bit integers)."""

    def __init__(self, split_at: str, special: tuple[str, ...], piece_ids, whole_ids, chunks: int = CHUNKS, pieces: int = PIECES):
        self.blank = split_at == "blank"
        self.chunks = Chunks(WORD_SPLIT if self.blank else BYTE_SPLIT, self.blank, "" if self.blank else " ", special, piece_ids, whole_ids, chunks, pieces)

    def __call__(self, text: bytes) -> bytes:
        get = self.chunks.__getitem__
        if self.blank:
            return b"".join(map(get, text.split()))
        if b"  " in text:
            return self.chunks.encode(text.decode("utf-8", "replace"))
        first, *rest = text.split(b" ")
        return self.chunks.encode(first.decode("utf-8", "replace")) + b"".join(map(get, rest))


_BLANK, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind and lower case of each byte; the lower case of each plain letter beyond ASCII, by code point, else 0."""
    kind = np.array([_ODD] * 33 + [_OTHER] * 94 + [_ODD] * 129, np.uint8)
    kind[shingles.SPACE] = _BLANK
    kind[ord("'")] = _ODD  # contractions depend on what stands around them
    kind[48:58], kind[65:91], kind[97:123] = _DIGIT, _LETTER, _LETTER
    low, letter = np.arange(256, dtype=np.uint8), np.zeros(0x180, np.uint16)
    low[65:91] += 32
    for c in range(0xC0, 0x180):
        letter[c] = ord(chr(c).lower()) if PLAIN.fullmatch(chr(c)) else 0
    return kind, low, letter


class PieceTable:
    """Pieces and their ids in arrays: a few bytes beside the piece, and no Python object, for each."""

    def __init__(self, ids_of: Callable[[str], list[int]], room: int):
        import pyarrow as pa

        self.ids_of, self.room = ids_of, room
        self.known, self.ids, self.sizes = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def __call__(self, pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of different pieces (an Arrow column), and ids and their numbers by row; pieces beyond the room are not kept."""
        import pyarrow as pa
        import pyarrow.compute as pc

        found = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(found.is_null())
        row, first = found.fill_null(-1).to_numpy(), len(self.known)
        row = np.where(row < 0, first - 1 + np.cumsum(row < 0), row)
        lists = [self.ids_of(x) for x in new.to_pylist()]
        sizes = np.append(self.sizes, np.fromiter(map(len, lists), np.int64, len(lists)))
        ids = np.append(self.ids, np.fromiter(chain.from_iterable(lists), "<u4"))
        if new.nbytes + first * 8 + self.known.nbytes + ids.nbytes <= self.room:
            self.known, self.ids, self.sizes = pa.concat_arrays([self.known, new]), ids, sizes
        return row, ids, sizes


class ColumnEncoder:
    """Columns of texts to ids, by an encoder that cuts at blanks; the same ids as it gives for each text.

    Pieces of plain chunks are looked up once for all places where they stand. A chunk with
    other characters, an apostrophe or a special token's string goes to the encoder as it is.
    """

    def __init__(self, encoder: TextEncoder, pieces: int = COLUMN_PIECES, window: int = WINDOW):
        if not encoder.blank:
            raise ValueError("columns are split at blanks only")
        self.chunks, self.window = encoder.chunks, window
        self.pieces = PieceTable(self.chunks.pieces.ids_of, pieces)
        self.blank = re.compile(rb"[\t-\r ]").search
        self.special = re.compile(b"|".join(map(re.escape, self.chunks.special))).search if self.chunks.special else None

    def __call__(self, column) -> list[bytes]:
        """Ids of each text of an Arrow column; none for nulls. Long texts are split between chunks, window by window."""
        data, at = shingles.raw(column)
        before, ids, lo, n = np.zeros(len(at), np.int64), [], 0, 0
        while lo < len(data):
            found = self.blank(data.data, lo + self.window) if lo + self.window < len(data) else None
            hi = found.end() if found else len(data)
            own = slice(*np.searchsorted(at, [lo, hi]))
            some, before[own] = self._encode(data[lo:hi], at[own] - lo)
            before[own] += n
            ids.append(some)
            lo, n = hi, n + len(some) // 4
        before[np.searchsorted(at, lo) :] = n
        whole, before = b"".join(ids), (4 * before).tolist()
        return [whole[a:b] for a, b in zip(before, before[1:])]

    def _odd(self, data: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """A place in each chunk, at least, that the encoder has to see as it is."""
        places, at = [], 0
        while self.special and (found := self.special(data.data, at)):
            places.append(found.start())
            at = found.start() + 1
        return np.sort(np.concatenate([np.flatnonzero(kind == _ODD), np.array(places, np.int64)]))

    def _encode(self, data: np.ndarray, texts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Ids of all chunks, and how many stand before each place where a text begins."""
        import pyarrow as pa

        kinds, lower, letter = _tables()
        kind, low, fresh = kinds[data], lower[data], np.zeros(len(data) + 1, bool)
        fresh[texts] = True
        lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
        code = letter[(data[lead] & 0x1F).astype(np.uint16) << 6 | data[lead + 1] & 0x3F]
        good = (code > 0) & (data[lead + 1] >> 6 == 2) & ~fresh[lead + 1]
        lead, code = lead[good], code[good]
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead], low[lead + 1] = 0xC0 | code >> 6, 0x80 | code & 0x3F
        cut = fresh[:-1] | (kind == _DIGIT)
        cut[0] = True
        cut[1:] |= kind[1:] != kind[:-1]
        plain, odd = kind != _BLANK, self._odd(data, kind)
        if len(odd):
            solid = np.append(plain, False)
            heads = np.flatnonzero(solid[:-1] & (np.append(True, ~solid[:-2]) | fresh[:-1]))
            tails = np.flatnonzero(solid[:-1] & (~solid[1:] | fresh[1:])) + 1
            own = np.unique(np.searchsorted(heads, odd, side="right") - 1)
            heads, tails = heads[own], tails[own]
            inside = np.zeros(len(data) + 1, np.int8)
            inside[heads] += 1
            inside[tails] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
            plain &= ~inside
            cut &= ~inside
            cut[heads], kind[heads] = True, _ODD
        start = np.flatnonzero(cut)
        size = np.diff(start, append=len(data))
        held = kind[start] != _BLANK
        start, size = start[held], size[held]
        usual = kind[start] != _ODD
        ends = np.zeros(int(usual.sum()) + 1, np.int32)
        np.cumsum(size[usual], out=ends[1:])
        pieces = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(low[plain])).dictionary_encode()
        row, ids, n = self.pieces(pieces.dictionary)
        which = np.empty(len(start), np.int64)
        which[usual] = row[pieces.indices.to_numpy()]
        which[~usual] = len(n) + np.arange(len(start) - len(ends) + 1)
        if len(odd):
            found = [np.frombuffer(self.chunks[data[a:b].tobytes()], "<u4") for a, b in zip(heads.tolist(), tails.tolist())]
            ids, n = np.concatenate([ids, *found]), np.append(n, [len(x) for x in found])
        first, n = (np.cumsum(n) - n)[which], n[which]
        last = np.cumsum(n)
        out = ids[np.repeat(first - last + n, n) + np.arange(n.sum())]
        return out.tobytes(), np.append(0, last)[np.searchsorted(start, texts)]


# How the files of the two vocabularies normalise and split, in the library's terms.
_SPLITS = {
    "blank": (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"),
    "space": ([], ["ByteLevel"], None),
}


@lru_cache(4)
def check_split(path: str, split_at: str) -> None:
    """Refuse a vocabulary file that normalises or splits texts in another way than ``split_at`` stands for."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    parts = lambda x, inner: [] if x is None else x[inner] if x["type"] == "Sequence" else [x]
    normal, split = parts(file["normalizer"], "normalizers"), parts(file["pre_tokenizer"], "pretokenizers")
    regex = next((x["pattern"].get("Regex") for x in split if x["type"] == "Split"), None)
    plain = [x for x in split if x["type"] == "ByteLevel" and not x["add_prefix_space"] and x["use_regex"] == (split_at == "space")]
    suffix = file["model"]["end_of_word_suffix"]
    found = ([x["type"] for x in normal], [x["type"] for x in split], regex)
    if found != _SPLITS[split_at] or not plain or (suffix is not None) != (split_at == "blank") or file["model"].get("ignore_merges"):
        raise ValueError(f"{path} does not split texts as {split_at!r} stands for")


def library(path: str):
    """The tokenizers library's own tokenizer, without truncation and padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def forget() -> None:
    """Drop what this worker remembers, and give its pages back to the system; tasks of other operators call it, as workers outlive theirs."""
    held = [getattr(sys.modules[m], name) for m, name in (("pitchloom.llm.automaton", "compiled"), ("pitchloom.llm.alignment", "aligner")) if m in sys.modules]
    if not _ENCODERS and not any(x.cache_info().currsize for x in held):
        return
    _ENCODERS.clear()
    for x in held:
        x.cache_clear()
    trim()


def trim() -> None:
    """Give what this worker no longer uses back to the system; idle workers stay beside other tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if give is not None:
        give(0)


def gives_back(run: Callable) -> Callable:
    """``run`` of a ``mapInArrow``, after which the worker keeps nothing of it.

    An executor may have more workers than cores, and takes them by turns: each would keep
    the most that any of its tasks needed.
    """

    def task(batches):
        forget()
        yield from run(batches)
        forget()
        trim()

    return task


def library_encoder(path: str, split_at: str, chunks: int = CHUNKS, pieces: int = PIECES) -> TextEncoder:
    """Ids by the tokenizers library: its model for pieces, all of it for the rest. One per worker."""
    if (path, split_at) not in _ENCODERS:
        check_split(path, split_at)
        tokenizer = library(path)
        model = tokenizer.model
        special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        spell = (lambda piece: piece if piece.isascii() else spelled(piece)) if split_at == "blank" else spelled  # without blanks, plain ASCII is spelled as it is
        _ENCODERS[path, split_at] = TextEncoder(
            split_at, special, lambda piece: [t.id for t in model.tokenize(spell(piece))], lambda text: tokenizer.encode(text, add_special_tokens=False).ids, chunks, pieces
        )
    return _ENCODERS[path, split_at]
