"""Odd tables, clashing names, budgets and brute-force versions of the corpus operators."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from pitchloom.llm import automaton, chat, langid, neighbours, overlap, packing, pfor, secrets, simhash, substrings, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CLASH = ["_id", "_k", "starts", "score", "lang_pred", "_gone", "h", "hs", "c", "n", "root", "_salt", "_rank", "_b", "_r"]
FORM = "doc_id long, text string, lang string, source string, n_chars long"


def word_maker(seed):
    rnd = random.Random(seed)
    return rnd, lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 7)))


# --- columns that clash, rows that repeat, texts that are long -------------------------


def test_stages_leave_columns_of_any_name_alone(spark):
    rnd, word = word_maker(1)
    base = " ".join(word() for _ in range(60))
    texts = [base, base + " more", "the " + " ".join(word() for _ in range(20)) + " " + base[:200], None, "", "password = hunter2222"]
    rows = [(k, t, "en", "s", len(t or ""), *[f"{c}-{k}" for c in CLASH]) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, FORM + "".join(f", {c} string" for c in CLASH))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[c] == f"{c}-{r['doc_id']}" for r in got for c in CLASH), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(texts)


def test_stages_on_an_empty_table_and_on_repeated_rows(spark):
    empty = spark.createDataFrame([], FORM)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
    row = (4, "one house and one garden of one king", "en", "s", 36)
    docs = spark.createDataFrame([row, row, (None, None, None, None, None)], FORM)
    counts = {name: stage(spark, docs, "").count() for name, stage in corpus_pipeline.STAGES}
    assert counts == {"language_id": 2, "ngram_jaccard_join": 2, "substring_dedup": 3, "secret_scans": 3, "best_fit_packing": 3}


@pytest.fixture(scope="module")
def long_texts():
    """A text of 2 MB without a blank in its middle, a copy of it, and one that shares a passage."""
    rnd, word = word_maker(2)
    many = " ".join(word() for _ in range(250_000))
    text = many + " " + "x" * 300_000 + " end"
    return [text, text, many[:4000] + " other"]


def test_long_texts(spark, long_texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(long_texts)], "doc_id long, text string")
    tokenizer = tokens.library(WORD)
    n = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in long_texts]
    assert {r["doc_id"]: r["n_tokens"] for r in automaton.digests(docs, WORD).collect()} == dict(enumerate(n))
    pieces = packing.pack_documents(docs, WORD).collect()
    assert sum(r["length"] for r in pieces) == sum(n) + 3 and max(r["length"] for r in pieces) == 2048
    assert {r["doc_id"]: r["component_id"] for r in overlap.join(docs).collect()} == {0: 0, 1: 0, 2: 2}
    gone = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.digests(docs).collect()}
    assert gone[0] == (250_002, 0) and gone[1] == (250_002, 250_002) and gone[2][1] >= len(long_texts[2].split()) - 2
    assert {r["n_assign"] for r in secrets.digests(secrets.scan(docs)).collect()} == {0}
    assert simhash.digests(docs).count() == 3
    learned = langid.fit(spark.createDataFrame([(1, "abc abd", "a"), (2, "xyz xyw", "b")], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.predict(docs, learned).collect()} == {"a"}


def test_token_files_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (None, "b"), (2, None)]
    pfor.write(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/ids", BYTE)
    got = sorted((str(r["doc_id"]), r["start"], r["n_tokens"]) for r in pfor.read_digests(spark, f"file://{tmp_path}/ids").collect())
    assert got == [("1", 2, 2), ("1", 4, 2), ("2", 6, 1), ("None", 0, 2)]


# --- nearest neighbours ------------------------------------------------------------------


def exact_nearest(x, q, k=10):
    d = ((x - x[q]) ** 2).sum(1)
    d[q] = np.inf
    return np.lexsort((np.arange(len(x)), d))[:k].tolist()


def recall(spark, x, every=100, **settings):
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.nearest(table, every=every, **settings).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert set(got) == set(range(0, len(x), every))
    # Vectors at the same distance as the last of the nearest count as found.
    return np.mean([np.mean([v in got[q] for v in exact_nearest(x, q)]) for q in got])


@pytest.mark.parametrize("leaf", [40, 5000])
def test_recall_of_plain_shifted_clustered_and_outlying_vectors(spark, leaf):
    rng = np.random.default_rng(3)
    plain = rng.normal(size=(1200, 16))
    outlier = plain.copy()
    outlier[501] = 1e9
    clustered = np.repeat(rng.normal(size=(12, 16)) * 20, 100, axis=0) + rng.normal(size=(1200, 16))
    scaled = plain * 10.0 ** np.arange(-8, 8)
    for x in (plain, plain + 1e4, outlier, clustered, scaled):
        assert recall(spark, x, leaf=leaf) >= 0.9


def test_neighbours_of_an_id_with_two_vectors_and_with_further_columns(spark):
    rows = [(0, [1.0, 0.0], "x"), (0, [9.0, 9.0], "y"), (1, [1.0, 1.0], "z"), (2, [9.0, 8.0], "w")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(table).collect()]
    assert sorted(got) == [(0, 1, 2), (0, 2, 1)]  # by its bytes, (9, 9) is the least of the two that may ask
    assert neighbours.nearest(table.where("vec_id > 9")).count() == 0


# --- n-gram Jaccard join -------------------------------------------------------------------


def test_lists_over_the_bound_are_not_merged(spark, monkeypatch):
    """With every list called short by the table, long ones must still be told and nothing be lost."""
    monkeypatch.setattr(overlap, "LIST", 8)
    monkeypatch.setattr(overlap, "long_lists", lambda table, n, bits: np.zeros(1 << bits, bool))
    rnd, word = word_maker(4)
    base = [word() for _ in range(60)]
    texts = []
    for _ in range(60):
        w = list(base)
        w[rnd.randrange(60)] = word()
        texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(30)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 85 * len(a | b):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert {r["doc_id"]: r["component_id"] for r in overlap.join(docs, block=100).collect()} == dict(enumerate(label))


@pytest.mark.parametrize("heaped, probed", [(128, 48), (3, 2), (8, 10**6), (1, 0)])
def test_every_way_to_divide_the_lists_gives_the_links(monkeypatch, heaped, probed):
    monkeypatch.setattr(overlap, "HEAPED", heaped)
    monkeypatch.setattr(overlap, "PROBED", probed)
    rng = np.random.default_rng(11)
    for _ in range(40):
        base, percent = rng.integers(0, 1 << 40, 60).astype(np.uint64), int(rng.choice([50, 80, 85, 95]))
        sets = [np.unique(np.concatenate([base[rng.random(60) < rng.choice([0.3, 0.9, 0.95])], rng.integers(0, 1 << 40, rng.integers(1, 9)).astype(np.uint64)])) for _ in range(30)]
        edges = [(i, j) for i in range(30) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]
        labels = []
        for found in (edges, overlap.divide_skip(sets, percent)):
            label = list(range(30))
            for i, j in found:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
            labels.append(label)
        assert labels[0] == labels[1]


def test_occurrences_by_heap_equal_counts():
    rng = np.random.default_rng(5)
    for least in (1, 2, 5, 9):
        lists = [np.flatnonzero(rng.random(200) < p) for p in rng.random(12) * 0.5]
        counts = Counter(np.concatenate(lists).tolist())
        assert overlap.occurrences(lists, least) == {k: v for k, v in counts.items() if v >= least}
    assert overlap.occurrences([], 1) == {}


# --- substring removal -------------------------------------------------------------------------


def test_levels_double():
    assert substrings.levels(13) == [7, 13] and substrings.levels(13, 4) == [4, 7, 13] and substrings.levels(50, 7) == [7, 13, 25, 50]
    assert substrings.levels(1) == [1] and substrings.levels(5) == [5] and substrings.levels(26, 1) == [1, 2, 4, 7, 13, 26]


def passages(seed):
    rnd, word = word_maker(seed)
    few = [word() for _ in range(12)]
    shared = [[rnd.choice(few) for _ in range(rnd.choice([3, 6, 9, 13, 14, 30, 60]))] for _ in range(25)]
    return [" ".join(sum((rnd.choice(shared) if rnd.random() < 0.6 else [word() for _ in range(4)] for _ in range(rnd.randint(0, 9))), [])) for _ in range(150)]


@pytest.mark.parametrize("length, shortest", [(13, 4), (13, 7), (30, 4), (8, 1)])
def test_three_levels_and_more(spark, length, shortest):
    texts = passages(6)
    first = {}
    for i, w in enumerate(map(str.split, texts)):
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    want = {}
    for i, w in enumerate(map(str.split, texts)):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        want[i] = sum(gone)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["n_removed"] for r in substrings.digests(docs, length, shortest).collect()} == want and sum(want.values())


def test_frequent_windows_are_decided_aside(spark, monkeypatch):
    """The path of frequent windows, forced on everything that is seen twice, changes no result."""
    texts = passages(7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = sorted(map(tuple, substrings.digests(docs).collect()))
    for name, value in (("SAMPLED", 1), ("SIGHTINGS", 2), ("HEAVY_SHARE", 1e-3)):
        monkeypatch.setattr(substrings, name, value)
    assert sorted(map(tuple, substrings.digests(docs).collect())) == plain


def test_nothing_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "o p q"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.digests(docs, 13, 4).collect()} == {1: (14, 0), 2: (3, 0), 3: (0, 0)}


# --- language ID ---------------------------------------------------------------------------------


def test_predictions_equal_those_of_exact_ngram_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    learned = langid.fit(docs, sample=10**6)
    grams = lambda t, n: [f[k : k + n] for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split() if (f := f" {w} ") for k in range(len(f) - n + 1)]
    rows = docs.collect()
    counts = {(l, n): Counter() for l in learned.languages for n in langid.LENGTHS}
    for r in rows:
        if r["lang"] is not None:
            for n in langid.LENGTHS:
                counts[r["lang"], n].update(grams(r["text"], n))
    sets = {}
    for n in langid.LENGTHS:
        share = {l: {g: c / counts[l, n].total() for g, c in counts[l, n].items()} for l in learned.languages}
        most = Counter()
        for s in share.values():
            for g, f in s.items():
                most[g] = max(most[g], f) if f >= langid.LEAST_SHARE else most[g]
        sets[n] = {l: {g for g, f in s.items() if f >= langid.LEAST_SHARE and f >= langid.LEAST_RATIO * most[g]} for l, s in share.items()}
    said = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, learned).collect()}
    clear = 0
    for r in rows:
        hits = {l: sum(g in sets[n][l] for n in langid.LENGTHS for g in grams(r["text"], n)) for l in learned.languages}
        best, second = sorted(hits.values())[-1], sorted(hits.values())[-2]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert said[r["doc_id"]] == "und"
        elif best > 1.05 * second + 3:  # beyond what false positives of the filter can do
            clear += 1
            assert hits[said[r["doc_id"]]] == best
    assert clear > 0.9 * len(rows)


# --- chat formatting --------------------------------------------------------------------------------


@pytest.mark.parametrize("budget, history", [(64, 16), (200, 80), (1024, 256)])
def test_no_window_has_more_tokens_than_the_budget(spark, budget, history):
    rnd, word = word_maker(8)
    odd = ["<|endoftext|>", "</s>", "\\", "\\\\", "<|im_end|>\n", "[INST]", "  ", "\n\n", "日本", " a"]
    rows = []
    for conv in range(30):
        for turn in range(rnd.randint(1, 30)):
            role = "system" if turn == 0 and conv % 2 else ["user", "assistant", "us\\er<s>\n"][rnd.randrange(3)]
            rows.append((conv, turn, role, "".join(rnd.choice([*odd, word() + " "]) for _ in range(rnd.choice([0, 1, 5, 20, 300])))))
    tokenizer = tokens.library(BYTE)
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), BYTE, budget, history).collect()
    whole = 0
    for r in windows:
        assert r["n_tokens"] == count(r["text"])
        turns = r["text"].split(chat.BEGIN)[1:]
        system = turns[0].startswith("system\n") and r["repeated"] > 0
        alone = len(turns) - r["repeated"] == 1 and r["repeated"] == int(system)
        assert r["n_tokens"] <= budget or alone
        whole += r["n_tokens"] <= budget
    assert whole > len(windows) / 3


# --- BPE ------------------------------------------------------------------------------------------------


def test_words_of_any_length_and_a_small_table(monkeypatch):
    monkeypatch.setattr(automaton, "ARCS", 1 << 6)
    machine, _ = automaton.compiled.__wrapped__(WORD)
    assert len(machine.table) == 64
    model = tokens.library(WORD).model
    rnd = random.Random(9)
    for size in (1, 2, 3, 7, 50, 1000, 20_000):
        for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "o", "eatinor"):
            word = "".join(rnd.choice(letters) for _ in range(size))
            assert machine.encode(word) == [t.id for t in model.tokenize(word)]


def test_a_vocabulary_that_splits_otherwise_is_refused():
    with pytest.raises(ValueError):
        tokens.library_encoder(BYTE, "blank")
    with pytest.raises(ValueError):
        tokens.library_encoder(WORD, "space")


def test_caches_are_bounded_in_bytes():
    encoder = tokens.TextEncoder("blank", (), lambda p: [len(p)], lambda t: [0], chunks=2000, pieces=1000)
    for k in range(500):
        encoder(f"word{k}".encode())
    assert 0 < len(encoder.chunks) <= 2000 // tokens.ENTRY and len(encoder.chunks.pieces) <= 1000 // tokens.ENTRY


# --- secrets ------------------------------------------------------------------------------------------------


def naive_spans(text):
    """All kinds by plain loops: maximal runs for access and hex, every pair of parts for the links."""
    base = [(m.start(), "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m.group(2)) >= 6]
    base += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    base += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    crosses = lambda a, b: any(x < b and y > a for x, _, y in base)
    names = [m.span(1) for m in secrets.IDENTIFIER.finditer(text)]
    weak = [(a, "identifier", b) for a, b in names]
    weak += [(a, "secret", b) for a, b in (m.span() for m in secrets.RANDOM.finditer(text)) if (a, b) not in names]
    weak += [(a, "endpoint", b) for a, b in (m.span() for m in secrets.ENDPOINT.finditer(text))]
    weak = [w for w in weak if not crosses(w[0], w[2])]
    roles = {"identifier": [w for w in weak if w[1] == "identifier"] + [x for x in base if x[1] == "access"], "secret": [w for w in weak if w[1] == "secret"] + [x for x in base if x[1] != "access"]}
    walls = [0, *(m.start() for m in re.finditer(r"\n[^\S\n]*\n", text)), len(text)]
    out = list(base)
    for a, kind, b in weak:
        low = max(max(w for w in walls[:-1] if w <= a), a - secrets.REACH)
        high = min(min(w for w in walls if w > a), b + secrets.REACH)
        if all(any(x < high and y > low for x, _, y in roles[r]) for r in {"identifier": ["secret"], "secret": ["identifier"], "endpoint": ["identifier", "secret"]}[kind]):
            out.append((a, kind, b))
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[1])))


def test_secrets_equal_plain_loops():
    rnd = random.Random(10)
    parts = ["client_id = agent7", "AKIA" + "Q" * 16, "AKIASHORT", "a1" * 14, "password: 'abcdef9'", "TOKEN=ab", "Zz9xKqW27LmPq81RtYv3", "https://h.example/x?y=1", "host: db.example.com:99", "user=bob99", "apikey == x", "secret=token=aaaaaaa", "é日", "\n\n", "\n \n", " ", "\n", "x" * 150, "0123456789abcdef0123456789abcdef", "plain words here"]
    hits = Counter()
    for _ in range(3000):
        text = "".join(rnd.choice(parts) + rnd.choice(["", " ", " ", "\n"]) for _ in range(rnd.randint(0, 14)))
        found = secrets.spans(text)
        assert found == naive_spans(text), text
        hits.update(k for _, k, _ in found)
    assert set(hits) == set(secrets.KINDS)


# --- long texts of one kind --------------------------------------------------------------


def test_many_weak_parts_in_one_text():
    rnd = random.Random(4)
    value = lambda: "".join(rnd.choice("abcdefghABCDEFGH0123456789") for _ in range(20))
    text = "\n".join(f"user: ab{k} and {value()}" for k in range(100_000))
    found = secrets.spans(text)
    few = text[: text.index("user: ab50 ")]
    assert len(found) > 190_000 and [s for s in found if s[2] < len(few) - 300] == [s for s in secrets.spans(few) if s[2] < len(few) - 300]


@pytest.mark.parametrize("text", ["word\n" * 400_000, "ein-satz,ohne_blank1" * 100_000])
def test_long_texts_without_blanks_are_cut(text):
    parts = [p for some, _ in langid.pieces([text]) for p in some]
    assert "".join(parts) == text and max(map(len, parts)) < 2 * langid.PIECE


def test_cuts_change_no_ngram():
    text = "Ein Satz, mit-Strichen_und 12Zahlen\nçà\tou là 東京 京都" * 7
    hashes = lambda texts: sorted(x for h, _ in langid.ngrams(texts)[1] for x in h.tolist())
    assert hashes([p for some, _ in langid.pieces([text], 9) for p in some]) == hashes([text])
