"""The corpus operators against brute-force versions, on small and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from pitchloom.llm import automaton, chat, langid, neighbours, overlap, packing, pfor, secrets, simhash, substrings, tokens
from pitchloom.llm.graph import components

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BLANK = "[^\x20\x09-\x0d]+"


def corpus():
    """Copies, near copies, shared passages, empty, null and long texts, odd characters, control strings."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeghinorstu") for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = text(120), text(40)
    out = [None, "", " \n ", "one two", "One  TWO", base, base, base.upper(), base + " more", base.replace(" ", "\n", 3), passage, "x " + passage + " y", text(60) + " " + passage, text(3000)]
    near = base.split()
    for k in range(6):
        near[k * 15] = f"w{k}"
        out.append(" ".join(near))
    out += ["Héllo WÖRLD's <|endoftext|> naïve  日本語 ½ \u00a0 İ Σας", "\\ </s>[INST] ok", "a\u0301 e\u0301 \ufb01 \U0001f600", "....", "12 34"]
    out += [text(rnd.randint(1, 60)) for _ in range(30)]
    return out


TEXTS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "h", 5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, h string, n string, k int").repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- op1 ---------------------------------------------------------------------------


@pytest.mark.parametrize("percentile", [0, 0.5, 0.9, 1])
def test_blocks_round_trip(percentile):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([7], np.uint32), rng.integers(0, 2**32, 700, dtype=np.uint32), np.full(256, 9, np.uint32), (rng.zipf(1.4, 5000) % 50000).astype(np.uint32)):
        payload = pfor.pack(ids, percentile)
        assert (pfor.unpack(payload) == ids).all()
        for b in range(-(-len(ids) // pfor.BLOCK)):
            assert (pfor.unpack(payload, b) == ids[b * 128 : b * 128 + 128]).all()


def test_token_files(spark, docs, empty, tmp_path):
    path = f"file://{tmp_path}/ids"
    pfor.write(docs, path, BYTE, end_id=0)
    got, start = by_id(pfor.read_digests(spark, path)), 0
    tokenizer = tokens.library(BYTE)
    for i, t in enumerate(TEXTS):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(TEXTS)
    assert by_id(pfor.read_ids(spark, path))[3]["ids"] == np.array(tokenizer.encode("one two").ids + [0], "<u4").tobytes()
    pfor.write(empty, f"{path}-empty", BYTE)
    assert pfor.read_digests(spark, f"{path}-empty").count() == 0


# --- op2 ---------------------------------------------------------------------------


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    x[10:40] = x[9]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] + [1.0] * 7), (2300, [1.0, None] + [1.0] * 6), (2400, []), (2500, [1.0] * 3)]
    got = defaultdict(list)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for r in neighbours.nearest(table, leaf=200, rounds=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        hits += len(set(best.tolist()) & {v for v, _ in found})
        assert len(found) == 10 and [s for _, s in found] == sorted(s for _, s in found)
        assert all(abs(s - d[v]) < 1e-12 for v, s in found)
    assert hits >= 0.9 * 150


def test_search_goes_on_until_the_beam_is_expanded(spark):
    table = spark.createDataFrame([(i, [float(i + 1)]) for i in range(41)], "vec_id long, embedding array<double>")
    _, short = neighbours.build(neighbours.nodes(neighbours.vectors(table), 11))
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)], "a long, b long, d double")
    start = short.where("node = 40").select(F.lit(40).cast("long").alias("q"), F.col("s").alias("x"), F.lit(0).cast("long").alias("node"))
    met = neighbours.search(start, short, chain, beam=60)
    assert {r["node"] for r in met.collect()} == set(range(41))


def test_neighbours_beside_an_outlier_and_among_near_copies(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1000, 8))
    x[500:900] = x[500] * (1 + 1e-6 * rng.normal(size=(400, 8)))
    x[77] *= 1e8
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q in range(0, 1000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        assert got[q] == np.lexsort((np.arange(1000), d))[:10].tolist(), q


def test_neighbours_of_copies_and_of_few(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in neighbours.nearest(same, every=10).where("query_id = 10").orderBy("rank").collect()] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest(few).collect()] == [(0, 1, 1, 1.0)]
    assert neighbours.nearest(few.where("vec_id > 5")).count() == 0


# --- op3 ---------------------------------------------------------------------------


def fingerprint(t):
    votes = np.zeros(64, dtype=np.int64)
    for w in re.split("[ \t-\r]+", t.lower()):
        h = xxhash.xxh64(w.encode(), seed=42).intdigest()
        votes += len(w) * np.array([1 if h >> j & 1 else -1 for j in range(64)])
    return sum(1 << j for j in range(64) if votes[j] > 0)


@pytest.mark.parametrize("buckets", [1, 7, 2000])
def test_simhash(docs, buckets):
    got = by_id(simhash.digests(docs, buckets))
    texts = [t or "" for t in TEXTS]
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        ed = t[: len(t) - half] + nxt[:half]
        a, b, c = map(fingerprint, (t, ed, nxt))
        want = (len(t), hashlib.sha256(ed.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", 1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64)
        assert tuple(got[i])[1:] == want


def test_simhash_of_nothing_and_repeated_rows(spark, empty):
    assert simhash.digests(empty).count() == 0
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "x")], "doc_id long, text string")
    got = simhash.digests(rows, 3).collect()
    assert len(got) == 4 and len({r["fingerprint"] for r in got}) == 3


def test_block_tables_find_all(spark):
    rnd = random.Random(2)
    prints = [rnd.getrandbits(64) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5))) for p in prints]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    got = {(r["a"], r["b"], r["distance"]) for r in simhash.neighbours(spark.createDataFrame([(p,) for p in signed], "f long"), 3, 6).collect()}
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert got == {(a, b, distance(a, b)) for k, a in enumerate(signed) for b in signed[k + 1 :] if distance(a, b) <= 3} and got


# --- op4 ---------------------------------------------------------------------------


def linked(texts, words, percent):
    sets = []
    for t in texts:
        w = re.findall(BLANK, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("words, percent, block", [(4, 85, 4_000_000), (5, 80, 300), (2, 50, 4_000_000)])
def test_jaccard_join(docs, words, percent, block):
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(overlap.join(docs, words, percent, block=block)).items()}
    assert got == linked(TEXTS, words, percent)


def test_jaccard_join_with_long_lists(spark):
    """A family far beyond what is merged, near copies of near copies, and a passage that all share."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base, shared = [word() for _ in range(80)], " ".join(word() for _ in range(30))
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(80)] = word()
        texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(rnd.randint(5, 40))) + " " + shared for _ in range(80)]
    got = by_id(overlap.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == linked(texts, 4, 85)


def test_divide_skip_equals_all_pairs():
    rng = np.random.default_rng(6)
    for _ in range(20):
        base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(60) < 0.93], rng.integers(0, 1 << 40, rng.integers(0, 5)).astype(np.uint64)])) for _ in range(40)]
        sets = [s for s in sets if len(s)]
        up = list(range(len(sets)))
        want = components_of(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))])
        assert components_of(len(sets), overlap.divide_skip(sets, 85)) == want and up


def components_of(n, edges):
    label = list(range(n))
    for i, j in edges:
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7), (-5, 400)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert all(got[i] == 0 for i in range(1, 51)) and got[200] == got[300] == 100 and got[400] == -5


def test_jaccard_join_odd_rows(spark, empty, docs):
    assert overlap.join(empty).count() == 0
    rows = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in overlap.join(rows).collect())
    assert got == [(0, 5), (3, 3), (5, 5), (5, 5)]
    kept = overlap.keep_one(rows, 5, 80).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "5", "None"]
    want = linked(TEXTS, 5, 80)
    assert {r["doc_id"] for r in overlap.keep_one(docs, 5, 80).collect()} == {i for i, (_, c) in want.items() if c == i}


def test_rows_without_an_id_link_two_documents(spark):
    rows = [(1 + k, " ".join(f"w{j}" for j in range(2 * k, 2 * k + 20))) for k in range(2)]
    bridge = (None, " ".join(f"w{j}" for j in range(1, 21)))
    schema = "doc_id long, text string"
    apart = overlap.join(spark.createDataFrame(rows, schema), words=1, percent=90)
    assert {(r["doc_id"], r["component_id"]) for r in apart.collect()} == {(1, 1), (2, 2)}
    met = overlap.join(spark.createDataFrame([*rows, bridge], schema), words=1, percent=90)
    assert {(r["doc_id"], r["component_id"]) for r in met.where("doc_id is not null").collect()} == {(1, 1), (2, 1)}


# --- op5 ---------------------------------------------------------------------------


def removed(texts, length):
    words = [re.findall(BLANK, t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    out = {}
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("length", [13, 2, 5])
def test_substrings(docs, length):
    got = {i: tuple(r)[1:] for i, r in by_id(substrings.digests(docs, length)).items()}
    assert got == removed(TEXTS, length)


def test_substrings_odd_rows(spark, empty):
    assert substrings.digests(empty).count() == 0
    run = " ".join("abcdefghijklmn")
    rows = spark.createDataFrame([(1, f"x\n{run}  y", 9), (2, f"q  {run}\tz\nr", 9), (2, "other", 9), (None, run, 9)], "doc_id long, text string, n_chars int")
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in substrings.without_repeats(rows).collect()}
    assert got == {(1, f"x\n{run}  y", 31 + 2), (2, "q  z\nr", 6), (2, "other", 5), (None, run, 27)} or {g[:2] for g in got} == {(1, f"x\n{run}  y"), (2, "q  z\nr"), (2, "other"), (None, run)}


# --- op6 ---------------------------------------------------------------------------


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, WORD, 64).collect()
    tokenizer, want, ends = tokens.library(WORD), {}, defaultdict(list)
    for i, t in enumerate(TEXTS):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want |= {(i, k): (a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    for r in rows:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for place in ends.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 64
    assert len(ends) <= -(-sum(r["length"] for r in rows) // 64) + 2
    assert packing.pack_documents(empty, WORD).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5, 1.1, 4000).astype(int), 1, 2048)
    plan = packing.Plan(Counter(lengths.tolist()), 2048)
    used = Counter()
    for m, group in plan.groups:
        assert sum(group) <= 2048
        for n in group:
            used[n] += m
    assert used == Counter(lengths.tolist())
    assert sum(m for m, _ in plan.groups) <= math.ceil(lengths.sum() / 2048) * 1.01 + 1


def test_nonnegative_least_squares():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    assert np.allclose(a @ packing.nonnegative_least_squares(a, np.array([3.0, 2.0])), [3, 2])
    assert packing.nonnegative_least_squares(np.array([[1.0]]), np.array([-1.0]))[0] == 0


# --- op7 ---------------------------------------------------------------------------


def test_ngrams_are_those_of_framed_words():
    texts = ["ab, c", None, "12", "Éa b", ""]
    has, grams = langid.ngrams(texts)
    assert has.tolist() == [True, False, False, True, False]
    for n, (h, owner) in zip(langid.LENGTHS, grams):
        for k, t in enumerate(texts):
            framed = [f" {w} " for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()]
            assert (owner == k).sum() == sum(max(0, len(w) - n + 1) for w in framed)


def test_language_id(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = langid.fit(docs.where(~langid.held_out(docs)))
    assert learned.languages == ["de", "en", "es", "fr"] and (learned.wrong < 0.05).all()
    rows = langid.predict(docs.where(langid.held_out(docs)), learned).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, 2), (2, "12 34!", 2), (3, "日本", 2)], "doc_id long, text string, score int")
    got = by_id(langid.predict(odd, learned))
    assert [got[i]["lang_pred"] for i in (1, 2)] == ["und", "und"] and got[3]["lang_pred"] in learned.languages and got[3]["score"] == 0
    nothing = langid.fit(empty)
    assert langid.predict(odd, nothing).where("lang_pred <> 'und'").count() == 0


# --- op8 ---------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "a", "\\", "</s>", "\\</s>", "<\\/s>", "<|im_end|>\n", "[INST] \\\\[/INST]", "<<SYS>><</SYS>>", "<<s>s>", "line\nline"])
def test_escaping(text):
    assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_chat_windows(spark):
    rnd = random.Random(8)
    rows = []
    for conv in range(12):
        for turn in range(rnd.randint(1, 25)):
            role = "system" if turn == 0 and conv % 3 == 0 else ["user", "assistant"][turn % 2]
            rows.append((conv, turn, role, rnd.choice(["", None, "</s> \\ <|im_end|>", "word " * rnd.randint(1, 60)])))
    rows += [(None, 1, "user", "x"), (50, 1, None, "y"), (50, 1, None, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df, BYTE, budget=120, history=40).persist()
    got = {r["conv_id"]: r for r in chat.digests(windows).collect()}
    by = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        by[c].append((r or "", x or ""))
    for c, turns in by.items():
        target = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(target), hashlib.sha256(target.encode()).hexdigest())
    for r in windows.collect():
        turns = chat.parse(r["text"])
        assert r["n_tokens"] <= 120 or len(turns) - r["repeated"] == 1
        if r["conv_id"] is not None and r["conv_id"] % 3 == 0 and by[r["conv_id"]][0][0] == "system":
            assert turns[0][0] == "system"
    assert any(r["repeated"] > 1 for r in windows.collect())
    assert chat.digests(chat.format_windows(df.where("conv_id = 999"), BYTE)).count() == 0


# --- op9 ---------------------------------------------------------------------------


def test_automaton_equals_the_library():
    machine, encoder = automaton.compiled(WORD)
    tokenizer = tokens.library(WORD)
    rnd = random.Random(9)
    for _ in range(4000):
        word = tokens.spelled("".join(rnd.choice(rnd.choice(["abcdefghijklmnopqrstuvwxyz", "eatno", "o", "123!?.", "éüß日"])) for _ in range(rnd.randint(1, 14))))
        assert machine.encode(word) == [t.id for t in tokenizer.model.tokenize(word)]
    for t in TEXTS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(encoder((t or "").encode()), "<u4").tolist() == ids
        assert machine.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_automaton_queries(docs, empty):
    tokenizer = tokens.library(WORD)
    got = by_id(automaton.digests(docs, WORD))
    for i, t in enumerate(TEXTS):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(got[i])[1:] == want
    encoded = automaton.encode(docs, WORD)
    assert by_id(automaton.decode(encoded, WORD))[3]["text"] == tokenizer.decode(tokenizer.encode("one two").ids, skip_special_tokens=False)
    assert automaton.digests(empty, WORD).count() == 0


def test_library_encoders_equal_the_library():
    for path, split in ((BYTE, "space"), (WORD, "blank")):
        tokenizer, encoder = tokens.library(path), tokens.library_encoder(path, split)
        for t in [*TEXTS, "a  b", " a", "a ", "\n\n a\n b", "a \n  b"]:
            assert np.frombuffer(encoder((t or "").encode()), "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


# --- op10 --------------------------------------------------------------------------


def test_secrets(spark, empty):
    key = "AKIA" + "B" * 16
    texts = [
        None, "", 'Password: "hunter22" token=ab', "SECRET=abcdef apikey = 'zzzzzz9'", key, "AKIASHORT", "f" * 24 + "g" + "0" * 23,
        "client_id = agent7\nabcdEFGH1234ijklMNOP5678 http://x.example/y", "abcdEFGH1234ijklMNOP5678 http://x.example/y", "client_id = agent7", f"é {key} {'Zz9' * 12}",
        "client_id = agent7\n\n" + "abcdEFGH1234ijklMNOP5678", "client_id = agent7" + " " * 400 + "abcdEFGH1234ijklMNOP5678",
    ]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = by_id(secrets.digests(secrets.scan(df)))
    assert [got[i]["n_assign"] for i in (0, 1, 2, 3)] == [0, 0, 1, 2]
    assert got[4]["n_access"] == 1 and got[5]["n_access"] == 0 and got[6]["n_hex"] == 1 and got[6]["spans"] == "hex:0:24"
    assert got[7]["spans"] == "identifier:12:18,secret:19:43,endpoint:44:62"
    assert got[8]["spans"] == got[9]["spans"] == got[11]["spans"] == got[12]["spans"] == ""
    assert got[10]["spans"] == "access:2:22,secret:23:59" and got[10]["base_sha256"] == hashlib.sha256(b"access:2:22").hexdigest()
    masked = by_id(secrets.redact(df))
    assert masked[10]["text"] == f"é {secrets.MASK} {secrets.MASK}" and masked[10]["n_chars"] == len(masked[10]["text"])
    assert masked[0]["text"] is None and masked[1]["text"] == "" and masked[9]["text"] == texts[9]
    assert secrets.scan(empty).count() == 0
