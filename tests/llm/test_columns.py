"""Whole columns of texts to ids: the same as text by text, with each different piece asked for once."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pitchloom.llm import tokens

WORD = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", "hello", "World", "é", "É", "İ", "ß", "×", "÷", "Ÿ", "ı", "ŉ", "0", "9", "'", "'s", "'RE", ".", ",!", "-", " ", " ", "\t", "\n", "\x0b", "\x1c", "\x00", "\x7f", "\xa0", "日", "é", "—", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startof", "text|>", "😀"]


@pytest.mark.parametrize("window", [1, 9, tokens.WINDOW])
@pytest.mark.parametrize("room", [0, tokens.COLUMN_PIECES])
def test_columns_equal_the_library(window, room):
    rnd, library = random.Random(window), tokens.library(WORD)
    columns = tokens.ColumnEncoder(tokens.library_encoder(WORD, "blank"), room, window)
    for _ in range(60):
        texts = [None if rnd.random() < 0.1 else "".join(rnd.choice(PARTS) for _ in range(rnd.choice([0, 1, 3, 25]))) for _ in range(rnd.randint(0, 9))]
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in columns(pa.array(texts, pa.string()))] == want
        assert [np.frombuffer(x, "<u4").tolist() for x in columns(pa.array(["x", *texts], pa.string()).slice(1))] == want


def test_texts_that_are_cut_within_a_character():
    encoder = tokens.library_encoder(WORD, "blank")
    texts = ["é".encode()[:1], "é".encode()[1:], "aé".encode()[:2], "日".encode()[:2], b"\x80b c", b"\xc3"]
    assert tokens.ColumnEncoder(encoder)(pa.array(texts, pa.binary())) == [encoder(t) for t in texts]


def test_each_different_piece_is_asked_for_once():
    asked = []
    encoder = tokens.TextEncoder("blank", (), lambda piece: asked.append(piece) or [len(asked)], lambda text: [0])
    columns, letters = tokens.ColumnEncoder(encoder), "abcdefghijklmnopqrst"
    words = [f"{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters]
    for _ in range(2):
        assert sum(map(len, columns(pa.array([" ".join(words[k : k + 4000]) + "." for k in range(0, len(words), 4000)])))) == 4 * (len(words) + 40)
    assert sorted(asked) == sorted([*words, "."])


def test_pieces_beyond_the_room_are_not_kept():
    table = tokens.PieceTable(lambda piece: [len(piece), 7], 100)
    for pieces in (["a", "bb"], ["bb", "c" * 99, "a"], ["ccc"], []):
        row, ids, sizes = table(pa.array(pieces, pa.string()))
        first = np.cumsum(sizes) - sizes
        assert [ids[first[r] : first[r] + sizes[r]].tolist() for r in row] == [[len(x), 7] for x in pieces]
        assert table.known.nbytes + table.ids.nbytes + table.sizes.nbytes <= 100
    assert table.known.to_pylist() == ["a", "bb", "ccc"]
