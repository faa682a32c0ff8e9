"""Phrase collocations by compressed position bitmaps, in the manner of SPAM.

Texts are cut into pieces and words. A shard is a run of some ``SHARD`` words of a task's
texts, with a gap between pieces, so that no phrase crosses one. Within a shard a word
is a bitmap of its positions, compressed to the bytes that are not zero (:class:`Bitmaps`).
A phrase is extended by a word with a shift of its bitmap, an AND with the word's, and a
popcount; all extensions of a group of first words are made at once and depth-first:
their phrases of two words, then of three, and so on, before the next group's.

What is counted is pruned by what is frequent in the whole corpus:

1. :func:`_shards` writes the shards, with each one's words and counts.
2. Words are summed over shards. Those of at least ``least`` occurrences, and only those,
   go back to the shards they stand in.
3. Pairs of such words are counted in the shards and summed; frequent ones go back.
4. Longer phrases are extended only where every pair in them is frequent, and summed.

Sums and ways back are shuffles by word, pair or shard: no set of frequent phrases is
broadcast or collected. Words (with their language) are told by 64-bit hashes, phrases
by the hashes of their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitchloom.llm import shingles, tokens
from pitchloom.llm.common import discard, partitions, stored

LEAST, LONGEST, TOP = 30, 4, 2000
#: A candidate inside a longer phrase goes if that has this percentage of its occurrences.
COVERED = 80
#: Words of a shard (a longer piece is a shard of its own), and bytes of bitmaps that are extended at once.
SHARD, GROUP = 1 << 20, 1 << 15
#: Scores are this many times ``a / (l + r)``, rounded down.
SCALE = 2_000_000

_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", 10, 11, 12, 13]] = True
_BREAK = _CUT.copy()
_BREAK[[9, 32]] = True
_POP = np.array([bin(k).count("1") for k in range(256)], np.uint8)
_A = np.uint64(0x9E3779B97F4A7C15)

SHARDS = "shard long, ids binary, hs array<long>, texts array<string>, langs array<string>, counts array<long>"


# --- shards -----------------------------------------------------------------------------


def _word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, its text, and whether it begins a piece."""
    solid = ~_BREAK[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[first], end[last] = solid[first], solid[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    cuts = np.cumsum(_CUT[data])[starts] if len(starts) else starts
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (cuts[1:] != cuts[:-1]) | (owner[1:] != owner[:-1])
    return starts, ends, owner, fresh


class _Shard:
    """Words of the shard that is being filled."""

    def __init__(self):
        self.hashes, self.words, self.size = [], [], 0

    def add(self, h: np.ndarray, fresh: np.ndarray, words) -> None:
        out = np.zeros(len(h) + int(fresh.sum()), np.uint64)  # 0: a gap
        out[np.arange(len(h)) + np.cumsum(fresh)] = h
        self.hashes.append(out)
        self.words.append(words)
        self.size += len(out)

    def row(self, number: int):
        """The shard as a row; its words are numbered by frequency, so that most numbers are small."""
        import pyarrow as pa

        all_ = np.concatenate(self.hashes)
        distinct, where, counts = np.unique(all_, return_inverse=True, return_counts=True)
        counts[distinct == 0] = len(all_) + 1  # the gap is number 0
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        ids = rank[where]
        halves = np.concatenate([(ids & 0xFFFF).astype("<u2"), (ids >> np.uint32(16)).astype("<u2")])
        order = order[1:]
        texts, langs = {}, {}
        for h, text, lang in self.words:
            for key, t, g in zip(h.tolist(), text, lang):
                if key not in texts:
                    texts[key], langs[key] = t, g
        keys = distinct[order].tolist()
        list_ = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([halves.tobytes()], pa.binary()), list_(distinct[order].view(np.int64), pa.int64()), list_([texts[k] for k in keys], pa.string()), list_([langs[k] for k in keys], pa.string()), list_(counts[order], pa.int64())],
            ["shard", "ids", "hs", "texts", "langs", "counts"],
        )


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _shards(docs: DataFrame) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        tokens.forget()
        number, shard = TaskContext.get().partitionId() << 36, _Shard()
        for batch in batches:
            for part in shingles.slices(batch, 0):
                data, offsets = shingles.raw(part.column(0))
                starts, ends, owner, fresh = _word_spans(data, offsets)
                if not len(starts):
                    continue
                langs = part.column(1).to_pylist()
                seeds = {g: _seed(g) for g in set(langs)}
                seed = np.array([seeds[g] for g in langs], np.uint64)
                h = shingles.mix(shingles.word_hashes(data, starts, ends, True) * _A + seed[owner])
                h[h == 0] = 1
                # Whole pieces until the shard is full.
                heads = np.flatnonzero(fresh)
                at = 0
                while at < len(h):
                    room = max(0, SHARD - shard.size)
                    to = len(h) if len(h) - at <= room else int(heads[min(len(heads) - 1, np.searchsorted(heads, at + room, side="right") - 1)])
                    if to <= at and not shard.size:  # a piece beyond a shard's size
                        later = np.searchsorted(heads, at, side="right")
                        to = int(heads[later]) if later < len(heads) else len(h)
                    if to > at:
                        own = h[at:to]
                        distinct, first = np.unique(own, return_index=True)
                        spans = [(starts[at + k], ends[at + k], owner[at + k]) for k in first.tolist()]
                        shard.add(own, fresh[at:to], (distinct, [data[a:b].tobytes().lower().decode("utf-8", "replace") for a, b, _ in spans], [langs[o] for _, _, o in spans]))
                        at = to
                    if at < len(h):
                        yield shard.row(number)
                        number, shard = number + 1, _Shard()
                        tokens.trim()
        if shard.size:
            yield shard.row(number)
        shard = None
        tokens.trim()

    texts = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).where("text is not null")
    return stored(texts.mapInArrow(run, SHARDS), "shards")


def _ids(cell) -> np.ndarray:
    halves = np.frombuffer(cell.as_buffer(), "<u2")
    n = len(halves) // 2
    return halves[:n] | halves[n:].astype(np.uint32) << np.uint32(16)


# --- bitmaps ----------------------------------------------------------------------------


class Bitmaps:
    """Compressed bitmaps of the positions of the words of a shard.

    A bitmap is its bytes that are not zero, each with its number: 8 positions. ``by_word``
    holds those of word ``w`` (``number``, ``bits``) from ``start[w]`` to ``start[w + 1]``;
    ``at`` holds those of the same byte number side by side, for all words at once.
    """

    def __init__(self, ids: np.ndarray, words: int):
        """``ids``: the word at each position, negative where there is none."""
        place = np.flatnonzero(ids >= 0)
        byte, bit = place >> 3, np.left_shift(1, place & 7).astype(np.uint8)
        order = np.argsort(byte * np.int64(words) + ids[place], kind="stable")
        byte, word, bit = byte[order], ids[place][order], bit[order]
        new = np.ones(len(byte), bool)
        new[1:] = (byte[1:] != byte[:-1]) | (word[1:] != word[:-1])
        first = np.flatnonzero(new)
        self.words = words
        self.number, self.word = byte[first], word[first]
        self.bits = np.bitwise_or.reduceat(bit, first) if len(first) else bit
        self.at = np.searchsorted(self.number, np.arange((len(ids) >> 3) + 3))
        self.by_word = np.argsort(self.word, kind="stable")
        self.start = np.searchsorted(self.word[self.by_word], np.arange(words + 1))

    def groups(self):
        """Ranges of words whose bitmaps have about ``GROUP`` bytes; a word's bitmap is never divided."""
        a = 0
        while a < self.words:
            b = max(a + 1, int(np.searchsorted(self.start, self.start[a] + GROUP, side="right")) - 1)
            yield a, min(b, self.words)
            a = b

    def of(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps of the words from ``a`` to ``b``: word less ``a``, byte numbers, bits."""
        at = self.by_word[self.start[a] : self.start[b]]
        return self.word[at] - a, self.number[at], self.bits[at]

    def extended(self, phrase: np.ndarray, number: np.ndarray, bits: np.ndarray):
        """All phrases with one more word: ``prefix, word, count`` of each, and their bitmaps.

        A shift by one position carries the highest bit into the next byte; the AND meets
        all words that have that byte; the popcounts of a phrase's bytes are summed.
        """
        low, high = (bits << 1).astype(np.uint8), bits >> 7
        keep, carry = np.flatnonzero(low), np.flatnonzero(high)
        phrase, number, bits = np.concatenate([phrase[keep], phrase[carry]]), np.concatenate([number[keep], number[carry] + 1]), np.concatenate([low[keep], high[carry]])
        begin, n = self.at[number], self.at[number + 1] - self.at[number]
        behind = np.cumsum(n)
        entry = np.arange(behind[-1] if len(behind) else 0) + np.repeat(begin - behind + n, n)
        both = self.bits[entry] & np.repeat(bits, n)
        met = np.flatnonzero(both)
        entry, both = entry[met], both[met]
        key = np.repeat(phrase, n)[met] * np.int64(self.words) + self.word[entry]
        order = np.argsort(key, kind="stable")
        key, both, number = key[order], both[order], self.number[entry[order]]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        count = np.add.reduceat(_POP[both].astype(np.int64), first) if len(first) else first
        return key[first] // self.words, key[first] % self.words, count, (np.cumsum(new) - 1, number, both)


def _chosen(keep: np.ndarray, bitmaps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps of the phrases that are kept, numbered anew."""
    phrase, number, bits = bitmaps
    stay = np.flatnonzero(keep[phrase])
    return (np.cumsum(keep) - 1)[phrase[stay]], number[stay], bits[stay]


def _among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return shingles.mix(a * _A + shingles.mix(b))


def _frequent_words(ids: np.ndarray, hs: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a shard with only its frequent words (numbered anew, -1 for others), and their hashes."""
    keep = np.append(False, _among(hs, frequent))
    return np.where(keep, np.cumsum(keep) - 1, -1)[ids], hs[keep[1:]]


# --- passes over the shards ---------------------------------------------------------------


def _pairs(shards: DataFrame) -> DataFrame:
    """``h, shard, n``: pairs of frequent words in each shard (``shard, ids, hs, words``)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                hs = batch.column(2)[k].values.to_numpy().view(np.uint64)
                ids, hs = _frequent_words(_ids(batch.column(1)[k]), hs, np.frombuffer(batch.column(3)[k].as_buffer(), np.uint64))
                maps = Bitmaps(ids, len(hs))
                for a, b in maps.groups():
                    prefix, word, count, _ = maps.extended(*maps.of(a, b))
                    if len(count):
                        yield pa.RecordBatch.from_arrays([pa.array(_pair_hash(hs[prefix + a], hs[word]).view(np.int64)), batch.column(0).take(pa.array([k] * len(count))), pa.array(count)], ["h", "shard", "n"])

    return shards.mapInArrow(run, "h long, shard long, n long")


def _longer(shards: DataFrame, longest: int) -> DataFrame:
    """``w0, w1, …, n``: phrases of three words and more in each shard (``shard, ids, hs, words, pairs, pairs_total``), of frequent pairs only; and these pairs, once."""

    def run(batches):
        import pyarrow as pa

        def rows(words, hs, count):
            columns = [pa.array(hs[w].view(np.int64)) for w in words] + [pa.array(np.zeros(len(count), np.int64))] * (longest - len(words))
            return pa.RecordBatch.from_arrays([*columns, pa.array(count)], [*[f"w{j}" for j in range(longest)], "n"])

        for batch in batches:
            for k in range(batch.num_rows):
                hs = batch.column(2)[k].values.to_numpy().view(np.uint64)
                ids, hs = _frequent_words(_ids(batch.column(1)[k]), hs, np.frombuffer(batch.column(3)[k].as_buffer(), np.uint64))
                pairs, totals = np.frombuffer(batch.column(4)[k].as_buffer(), np.uint64), np.frombuffer(batch.column(5)[k].as_buffer(), np.int64)
                maps = Bitmaps(ids, len(hs))
                for a, b in maps.groups():
                    words, bitmaps = [np.arange(a, b)], maps.of(a, b)
                    while len(words) < longest and len(bitmaps[0]):
                        prefix, word, count, bitmaps = maps.extended(*bitmaps)
                        pair = _pair_hash(hs[words[-1][prefix]], hs[word])
                        keep = _among(pair, pairs)
                        words = [*[w[prefix][keep] for w in words], word[keep]]
                        bitmaps = _chosen(keep, bitmaps)
                        count = count[keep]
                        if len(words) == 2 and len(count):
                            # Pairs are summed already: one shard of each tells the sum.
                            count = totals[np.searchsorted(pairs, pair[keep])]
                            told = np.flatnonzero(count)
                            if len(told):
                                yield rows([w[told] for w in words], hs, count[told])
                        elif len(count):
                            yield rows(words, hs, count)

    return shards.mapInArrow(run, ", ".join(f"w{j} long" for j in range(longest)) + ", n long")


def _back(rows: DataFrame, name: str) -> DataFrame:
    """``shard``, its hashes ``h`` ascending and their ``total`` as bytes: no more than the shard has places."""

    def run(batches):
        import pyarrow as pa

        key, held = None, []

        def done():
            h, total = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h)
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([h[order].tobytes()], pa.binary()), pa.array([total[order].tobytes()], pa.binary())], ["shard", name, f"{name}_total"])

        for batch in batches:
            shard, h, total = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64), np.asarray(batch.column(2))
            cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)) if len(shard) else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if held and shard[a] != key:
                    yield done()
                    held = []
                key = int(shard[a])
                held.append((h[a:b], total[a:b]))
        if held:
            yield done()

    sorted_ = rows.select("shard", "h", "total").repartition(partitions(rows.sparkSession), "shard").sortWithinPartitions("shard")
    return sorted_.mapInArrow(run, f"shard long, {name} binary, {name}_total binary")


def _frequent(rows: DataFrame, least: int, name: str) -> DataFrame:
    """A stored table ``shard, name, name_total``: of ``h, shard, n`` rows, each shard's hashes whose counts add up to ``least`` or more.

    The sum is given to one of a hash's shards, the others have 0.
    """
    same = W.partitionBy("h")
    summed = rows.withColumn("total", F.sum("n").over(same)).withColumn("first", F.min("shard").over(same)).where(F.col("total") >= least)
    return stored(_back(summed.withColumn("total", F.when(F.col("shard") == F.col("first"), F.col("total")).otherwise(F.lit(0))), name), name)


# --- collocations ---------------------------------------------------------------------------


def _key(words: list[Column]) -> Column:
    """A part of a phrase as a string of its words' hashes: two parts are equal if their words are."""
    return F.concat_ws(" ", *words)


def _parts(phrases: DataFrame, longest: int) -> DataFrame:
    """``phrase, n_words, a, k, left, right`` for every cut of every phrase (``w0, …, a``)."""
    words = [F.col(f"w{j}") for j in range(longest)]
    cuts = []
    for n in range(2, longest + 1):
        all_ = [F.struct(F.lit(k).alias("k"), _key(words[:k]).alias("left"), _key(words[k:n]).alias("right")) for k in range(1, n)]
        cuts.append((n, F.array(*all_)))
    each = F.when(F.lit(False), cuts[0][1])
    for n, array in cuts:
        each = each.when(F.col("n_words") == n, array)
    return phrases.select("phrase", "n_words", "a", F.explode_outer(each).alias("x")).select("phrase", "n_words", "a", "x.*")


def _inner(phrases: DataFrame, longest: int) -> DataFrame:
    """``phrase, most``: for phrases inside longer ones, the largest count of these."""
    words = [F.col(f"w{j}") for j in range(longest)]
    each = F.when(F.lit(False), F.array(F.lit("")))
    for n in range(3, longest + 1):
        each = each.when(F.col("n_words") == n, F.array(*[_key(words[i : i + m]) for m in range(2, n) for i in range(n - m + 1)]))
    return phrases.where("n_words > 2").select("a", F.explode_outer(each).alias("phrase")).groupBy("phrase").agg(F.max("a").alias("most"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    Words are runs without blanks, in lower case (A to Z), of pieces between signs and
    line ends. Candidates are phrases of 2 to ``longest`` words with ``least`` occurrences
    or more. ``a``, ``l``, ``r`` are the occurrences of a phrase and of its two parts at
    the cut with the lowest score (the first such cut), ``n`` those of all words of the
    language. A candidate inside a longer one with ``COVERED`` percent of its occurrences
    is left out. Order: score, ``a`` (both descending), phrase by its bytes.

    Null texts are empty; a null language is ``und``. ``doc_id`` plays no part: repeated
    rows count each time. An empty table, or one without frequent phrases, gives an empty
    one. A long text lies in several shards, cut between pieces. Further columns are left
    out, whatever their names.
    """
    shards = _shards(docs)
    each = F.explode_outer(F.arrays_zip("hs", "texts", "langs", "counts")).alias("x")
    words = stored(shards.select("shard", each).select("shard", F.col("x.hs").alias("h"), F.col("x.langs").alias("lang"), F.col("x.texts").alias("text"), F.col("x.counts").alias("n")), "words")
    counts = stored(words.groupBy("h").agg(F.first("lang").alias("lang"), F.first("text").alias("text"), F.sum("n").alias("a")).where(F.col("a") >= least), "counts")
    sizes = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    frequent = _frequent(words.select("h", "shard", "n"), least, "words")
    discard(words)
    with_words = shards.select("shard", "ids", "hs").join(frequent.select("shard", "words").hint("merge"), "shard")
    frequent_pairs = _frequent(_pairs(with_words), least, "pairs")
    keys = [f"w{j}" for j in range(longest)]
    found = _longer(with_words.join(frequent_pairs.hint("merge"), "shard").select("shard", "ids", "hs", "words", "pairs", "pairs_total"), longest).groupBy(*keys).agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    held = [F.when(F.col(c) != 0, F.col(c)) for c in keys]
    phrases = stored(found.select(*[x.alias(c) for x, c in zip(held, keys)], "a", _key(held).alias("phrase"), F.size(F.array_compact(F.array(*held))).alias("n_words")), "phrases")
    discard(shards, frequent, frequent_pairs)
    part_counts = phrases.select(F.col("phrase").alias("part"), F.col("a").alias("n_part")).unionByName(counts.select(F.col("h").cast("string").alias("part"), F.col("a").alias("n_part")))
    cuts = _parts(phrases, longest)
    cuts = cuts.join(part_counts.select(F.col("part").alias("left"), F.col("n_part").alias("l")), "left").join(part_counts.select(F.col("part").alias("right"), F.col("n_part").alias("r")), "right")
    big = lambda x: F.col(x).cast("decimal(38,0)")
    # ``div`` of whole decimals rounds down, as all numbers are positive.
    score = F.expr(f"cast((cast(a as decimal(38,0)) * {SCALE}) div (cast(l as decimal(38,0)) + cast(r as decimal(38,0))) as long)")
    best = cuts.withColumn("score", score).groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("phrase", "a", "x.l", "x.r", "x.score")
    kept = best.join(_inner(phrases, longest), "phrase", "left").where(F.col("most").isNull() | (big("most") * 100 < big("a") * COVERED)).drop("most")
    spelled = kept.select("phrase", "a", "l", "r", "score", F.posexplode(F.split("phrase", " ")).alias("at", "h")).withColumn("h", F.col("h").cast("long")).join(counts.select("h", "lang", "text"), "h")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ")
    named = spelled.groupBy(F.col("phrase").alias("key"), "a", "l", "r", "score").agg(F.first("lang").alias("lang"), whole.alias("phrase"))
    # Each task keeps its first rows of a language before these meet.
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
