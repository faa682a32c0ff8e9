"""Alignment of two tokenizers against a plain version, token by token."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pitchloom.llm import alignment, tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """Rows of the query for a list of texts."""
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    letter = {c: k for k, c in enumerate(tokens.byte_letters())}
    as_bytes = lambda k: bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode()
    docs = []
    for text in texts:
        a = [(k, bytes(letter[c] for c in lib.id_to_token(k))) for k in (lib.encode(" " + text, add_special_tokens=False).ids if text else [])]
        b = [(k, as_bytes(k)) for k in (sp.encode(text) if text else [])]
        want = (" " + text).encode() if text else b""
        docs.append((a, b) if text and b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], []))

    def spans(rows):
        at, out = 0, []
        for k, x in rows:
            out.append((k, at, at + len(x)))
            at += len(x)
        return out

    links, found = Counter(), []
    for a, b in docs:
        a, b = spans(a), spans(b)
        own = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        links.update(own)
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [",".join(str(k) for k, _, e in a if lo < e <= hi) + "|" + ",".join(str(k) for k, _, e in b if lo < e <= hi) for lo, hi in zip([0, *cuts], cuts)]
        found.append((len(a), len(b), len(cuts), own, ";".join(groups)))
    most = {}
    for (_, y), n in links.items():
        most[y] = max(most.get(y, 0), n)
    return [(n_a, n_b, g, len(own), sum(links[p] == most[p[1]] for p in own), sum(links[p] for p in own), hashlib.sha256(s.encode()).hexdigest() if s else "") for n_a, n_b, g, own, s in found]


TEXTS = [
    "The quick brown fox", "the quick brown fox", "", None, " leading and  double spaces ", "trailing ", "tabs\tand\nlines \n\n x", "naïve Ünïcode — 東京 🎉 é́", "a▁b has the sign of a space",
    "plain <|endoftext|> and <s> </s> strings", "\x00 zero", "x" * 3000, "it's we'll I'd 123456 7,8.9", "a", " ", "　wide　space", "The quick brown fox", "  no-break   b",
]


def shown(rows):
    return {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in rows}


@pytest.mark.parametrize("block", [alignment.BLOCK, 40])
def test_against_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, pairs string, n_a int").repartition(3)
    assert shown(alignment.digests(docs, A, B).collect()) == dict(enumerate(plain(TEXTS)))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r["doc_id"], r["text"][:1500]) for r in docs.where("doc_id < 60").collect()]
    got = shown(alignment.digests(spark.createDataFrame(texts, "doc_id long, text string"), A, B).collect())
    assert got == dict(zip([k for k, _ in texts], plain([t for _, t in texts])))


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.digests(empty, A, B).count() == 0
    rows = alignment.digests(spark.createDataFrame([(None, "one word"), (None, "one word"), (3, None)], "doc_id long, text string"), A, B).collect()
    assert sorted((r["doc_id"] or 0, r["n_a"], r["count_sum"]) for r in rows) == sorted([(0, *[plain(["one word"] * 2)[0][k] for k in (0, 5)])] * 2 + [(3, 0, 0)])


def test_tallies_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(alignment, "TALLY", 2)
    docs = spark.createDataFrame(list(enumerate(["one two three"] * 5)), "doc_id long, text string").repartition(1)
    monkeypatch.setattr(alignment, "SLICE", 10)
    assert {r["count_sum"] for r in alignment.digests(docs, A, B).collect()} == {plain(["one two three"] * 5)[0][5]}


def test_best_partners(spark):
    docs = spark.createDataFrame(list(enumerate(["the house", "the garden", "the house"])), "doc_id long, text string")
    best = {(r["b"], r["a"]): r["count"] for r in alignment.translations(docs, A, B).collect()}
    sp, lib = sentencepiece.SentencePieceProcessor(model_file=B), Tokenizer.from_file(A)
    assert best[sp.encode("the")[0], lib.encode(" the").ids[0]] == 3
