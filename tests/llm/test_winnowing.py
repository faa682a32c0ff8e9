"""Benchmark decontamination against plain loops."""

import hashlib
import random
import re

import pytest

from pitchloom.llm import winnowing

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, span=10):
    windows = {}
    for key, text in items:
        w = words(text)
        n = min(span, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(key)
    lengths = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= x
        ids = sorted(str(x) for x in found if x is not None)
        out.append((key, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(spark, docs, items, **more):
    found = winnowing.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **more)
    return sorted((tuple(r)[:6] for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    word = lambda: rnd.choice("the of and zero one two drei überall œuvre naïve 東京 x1 9".split()) + rnd.choice(["", "", "a", "b"])
    items = [(k, " ".join(word() for _ in range(rnd.choice([12, 30, 60])))) for k in range(12)]
    items += [(12, "Two words"), (13, "one"), (14, "zero-one, two; of THE naïve"), (15, None), (16, "..."), (3, items[3][1]), (None, "an item without its id has ten words and more"), (17, items[0][1]), (100, "seven words are quite a short item")]
    docs = []
    for k in range(40):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40)))]
        if k % 2:
            w = (items[rnd.randrange(12)][1] or "").split()
            a = rnd.randrange(len(w))
            parts.append(rnd.choice([" ", "\n\n", " -- "]).join(w[a : a + rnd.choice([9, 10, 14, 40])]).upper().replace("Ü", "ü").replace("Œ", "œ").replace("Ï", "ï"))
        docs.append((k, " ".join([*parts, word()])))
    docs += [(40, None), (41, ""), (42, "?! ..."), (None, items[2][1]), (None, items[2][1]), (7, items[4][1]), (43, "the " * 500), (44, "xx an item without its id has ten words and more yy"), (45, "Two words"), (46, "SEVEN words are quite a short item")]
    items.append((18, "the " * 25))
    return docs, items


def test_against_plain_loops(spark, corpus):
    assert got(spark, *corpus) == plain(*corpus)


def test_shuffled_tables_give_the_same(spark, corpus, monkeypatch):
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", 0)
    long_ = [x for x in corpus[1] if len(words(x[1])) >= 7]
    assert got(spark, corpus[0], long_) == plain(corpus[0], long_)


def test_other_spans(spark, corpus):
    docs, items = corpus[0][:15], corpus[1][:6]
    assert got(spark, docs, items, span=6, gram=3) == plain(docs, items, 6)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "one two", "a", "b", True, 2)], "doc_id long, text string, _n string, m string, _row boolean, item_id int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in winnowing.contamination(docs, none).collect()] == [(1, 2, 0, 0)]
    items = spark.createDataFrame([(5, "one two", 1)], "item_id long, text string, w int")
    assert [tuple(r)[:4] for r in winnowing.contamination(docs, items).collect()] == [(1, 2, 2, 1)]
    assert winnowing.contamination(docs.where("false"), items).count() == 0


def test_decontaminate_keeps_clean_rows_and_columns(spark):
    bad = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"so {bad} end", "x"), (2, "clean words only", "y"), (None, bad, "z"), (3, None, "n"), (2, "clean words only", "y")], "doc_id long, text string, _key string")
    kept = winnowing.decontaminate(docs, spark.createDataFrame([(1, bad)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r["_key"] for r in kept.collect()) == ["n", "y", "y"]


def test_long_text(spark):
    rnd = random.Random(3)
    w = [rnd.choice("abcdefgh") + str(rnd.randrange(99)) for _ in range(200_000)]
    items = [(1, " ".join(w[99_000:99_040]))]
    assert got(spark, [(1, " ".join(w))], items) == plain([(1, " ".join(w))], items)
