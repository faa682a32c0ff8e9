"""Collocations against plain counting, and bitmaps against positions."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pitchloom.llm import phrases


def plain(docs, least=30, longest=4, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, *w[k : k + m]) for k in range(len(w) - m + 1))
    found = [p for p in f if len(p) > 2 and f[p] >= least]
    most = Counter()
    for p in found:
        for m in range(2, len(p) - 1):
            for k in range(1, len(p) - m + 1):
                inner = (p[0], *p[k : k + m])
                most[inner] = max(most[inner], f[p])
    rows = {}
    for p in found:
        if 100 * most[p] >= 80 * f[p]:
            continue
        cuts = [(2_000_000 * f[p] // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        rows.setdefault(p[0], []).append((-score, -f[p], " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    return sorted((g, i + 1, p.decode(), -a, left, right, n[g], -s) for g, all_ in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(all_)[:top]))


def made(seed, rows, langs=("en", "fr", None)):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "Big", "house", "été", "a", "b", "東京", "x-y", "\x00"]
    weights = [9, 7, 3, 3, 2, 2, 2, 1, 1, 1]
    out = []
    for _ in range(rows):
        parts = []
        for _ in range(rnd.randint(0, 12)):
            parts += rnd.choices(vocabulary, weights, k=rnd.randint(0, 9)) + [rnd.choice([".", ", ", "\n", "?", "  ", "\t", "new york city "])]
        out.append((" ".join(parts), rnd.choice(langs)))
    return out


@pytest.mark.parametrize(("shard", "group"), [(1 << 20, 1 << 17), (50, 3), (1, 1)])
def test_against_plain_counting(spark, monkeypatch, shard, group):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "GROUP", group)
    docs = made(1, 60 if shard == 1 else 300)
    df = spark.createDataFrame([(t, g, 1, "x") for t, g in docs], "text string, lang string, n int, shard string").repartition(3)
    least = 5 if shard == 1 else 30
    assert sorted(map(tuple, phrases.collocations(df, least=least).collect())) == plain(docs, least)


def test_other_lengths_and_top(spark):
    docs = made(2, 200)
    df = spark.createDataFrame(docs, "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(df, least=10, longest=3, top=7).collect())) == plain(docs, 10, 3, 7)
    assert sorted(map(tuple, phrases.collocations(df, least=10, longest=2).collect())) == plain(docs, 10, 2)


def test_odd_tables(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    df = spark.createDataFrame([(None, "en"), ("", None), (".,;", "fr"), ("one two", "en")], "text string, lang string")
    assert phrases.collocations(df).count() == 0
    same = [("one two", "und"), ("one two", None)] * 15
    assert [tuple(r) for r in phrases.collocations(spark.createDataFrame(same, "text string, lang string")).collect()] == [("und", 1, "one two", 30, 30, 30, 60, 1_000_000)]


def test_long_texts_and_one_word(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 1000)
    docs = [("the " * 5000, "en"), ("the big. " * 3000, "en"), ("the " * 40, "fr")]
    df = spark.createDataFrame(docs, "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(df).collect())) == plain(docs)


def test_bitmaps():
    rng = np.random.default_rng(1)
    ids = rng.integers(-1, 5, 3000)
    maps = phrases.Bitmaps(ids, 5)
    prefix, word, count, (phrase, number, bits) = maps.extended(*maps.of(0, 5))
    want = Counter(zip(ids[:-1].tolist(), ids[1:].tolist()))
    assert dict(zip(zip(prefix.tolist(), word.tolist()), count.tolist())) == {k: v for k, v in want.items() if min(k) >= 0}
    places = {(int(p), 8 * int(n) + b) for p, n, x in zip(phrase, number, bits) for b in range(8) if x >> b & 1}
    assert places == {(k, j + 1) for k, (a, b) in enumerate(zip(prefix.tolist(), word.tolist())) for j in range(len(ids) - 1) if (ids[j], ids[j + 1]) == (a, b)}
    assert [phrases.Bitmaps(np.full(9, -1), 0).extended(*maps.of(0, 0))[k].size for k in range(3)] == [0, 0, 0]
