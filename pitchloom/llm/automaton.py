"""BPE as a deterministic automaton over tokens, and its encoder and decoder.

The automaton starts with one state and a loop for every base symbol. Each merge
``u v -> w``, in order, is a gadget: arcs labelled ``u`` are redirected to a copy
of their target that lacks the arc ``v``, and wherever ``u v`` could be read an
arc ``w`` is added to where ``v`` led (before the redirection, if ``u`` is
``v``). All arcs with one label lead to one state, so the automaton is
deterministic and is kept in arrays by token: its target, its left part, the merge
that made it; and by state: whose gadget made it, and when. A copy shares its
origin's arcs; an arc added later exists exactly if the arc of its left part does.
Thus a gadget costs constant time and space. Arcs that were asked for are kept in a
table of transitions, an array of fixed size with one place per arc.

The paths of the automaton spell exactly the correct segmentations, and each part
from the start of one is one itself. So every prefix of a word has a single path:
the encoder goes through the word once and notes for each prefix the last arc of its
path, which is the one whose transition exists from the path of the prefix before it.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from pitchloom.llm import shingles, tokens
from pitchloom.llm.common import id_text

#: Places of the table of transitions, of 8 bytes each. An arc overwrites one with the same place.
ARCS = 1 << 20
#: Bytes that a worker spends on words here, as a miss costs more than in the library.
CHUNKS, PIECES = 112 << 20, 40 << 20
_ID = 24  # bits of an id in the table's entries


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        size = max(vocab.values()) + 1
        if size >= 1 << _ID:
            raise ValueError("too many tokens")
        self.label = [""] * size
        for text, i in vocab.items():
            self.label[i] = text
        made = [vocab[a + b] for a, b in merges]
        if len(set(made)) < len(made):
            raise ValueError("two merges make one token")
        self.born = array("i", [-1]) * size
        self.left = array("i", [-1]) * size
        self.target = array("i", [0]) * size  # where arcs with this label lead
        self.first = array("i", [0]) * size  # where they led before any gadget of this label
        self.owner, self.since = array("i", [-1]), array("i", [-1])  # of each state: the label whose gadget made it, and when
        self.removed: dict[int, int] = {}  # label and arc that its gadget took away: when
        self.table = array("q", [0]) * ARCS
        unreachable = set()
        for k, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u in unreachable or v in unreachable or not self._has(self.target[u], v):
                unreachable.add(w)
                continue
            self.born[w], self.left[w] = k, u
            self.first[w] = self.target[w] = self.target[v]
            self.owner.append(u)
            self.since.append(k)
            self.removed[u << _ID | v] = k
            self.target[u] = len(self.owner) - 1
        self.spellings = {t: i for t, i in vocab.items() if i not in unreachable and (self.born[i] >= 0 or len(t.removesuffix(suffix)) == 1)}
        # By the last three letters, the length of the longest label that ends in them: inside a word, and at its end.
        self.inside, self.at_end = {}, {}
        for text in self.spellings:
            last = bool(suffix) and text.endswith(suffix)
            body, known = (text.removesuffix(suffix), self.at_end) if last else (text, self.inside)
            if len(body) > 2:
                known[body[-3:]] = max(known.get(body[-3:], 0), len(body))
        if not suffix:
            self.at_end = self.inside

    def _has(self, state: int, token: int) -> bool:
        """Whether a state has an arc: no gadget along its origins removed it or, before it was added, its left part."""
        removed, left, born = self.removed, self.left, self.born
        while state:
            label, made = self.owner[state], self.since[state]
            part, until = token, 1 << 40
            while part >= 0:
                at = removed.get(label << _ID | part)
                if at is not None and at <= made and at <= until:
                    return False
                part, until = left[part], born[part]
            state = self.first[label]
        return True

    def follows(self, before: int, token: int) -> bool:
        """Whether the state behind ``before`` has an arc ``token``, by the table of transitions."""
        arc = before << _ID | token
        place = (before * 0x9E3779B1 + token * 0x85EBCA77 >> 8) & ARCS - 1
        entry = self.table[place]
        if entry >> 1 == arc + 1:
            return entry & 1 == 1
        found = self._has(self.target[before], token)
        self.table[place] = arc + 1 << 1 | found
        return found

    def encode(self, word: str) -> list[int]:
        """Ids of one word in the vocabulary's alphabet, in time linear in its length."""
        spellings, follows, suffix, n = self.spellings, self.follows, self.suffix, len(word)
        whole = spellings.get(word + suffix)
        if whole is not None:
            return [whole]
        last, start = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            behind, known = (suffix, self.at_end) if end == n else ("", self.inside)
            for at in range(max(0, end - known.get(word[max(0, end - 3) : end], 2)), end):
                token = spellings.get(word[at:end] + behind)
                if token is not None and (not at or last[at] >= 0 and follows(last[at], token)):
                    last[end], start[end] = token, at
                    break
        if n and last[n] < 0:
            raise ValueError(f"no path spells {word!r}")
        out, at = [], n
        while at:
            out.append(last[at])
            at = start[at]
        return out[::-1]

    def decode(self, ids) -> str:
        """The labels of the arcs, joined as the vocabulary's missing decoder asks: by a space."""
        return " ".join([self.label[i] for i in ids])


@lru_cache(2)
def compiled(path: str) -> tuple[Automaton, tokens.TextEncoder]:
    """Automaton and text encoder of a vocabulary file; one per worker.

    Chunks that hold unusual characters are normalised and pre-split by the
    tokenizers library; their words, too, go through the automaton.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    machine = Automaton(dict(model["vocab"]), [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"] or "")
    tokenizer = tokens.library(path)
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    for text, i in added.items():
        machine.label += [""] * (i + 1 - len(machine.label))
        machine.label[i] = text

    def segments(text: str):
        while text:
            at, content = min(((text.find(c), c) for c in added if c in text), key=lambda x: (x[0], -len(x[1])), default=(len(text), ""))
            if at:
                yield text[:at], None
            if content:
                yield content, added[content]
            text = text[at + len(content) :]

    def whole(text: str) -> list[int]:
        out = []
        for part, special in segments(text):
            if special is not None:
                out.append(special)
                continue
            normal = tokenizer.normalizer.normalize_str(part) if tokenizer.normalizer else part
            for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                out += machine.encode(piece)
        return out

    split_at = "blank" if machine.suffix else "space"
    tokens.check_split(path, split_at)
    encoder = tokens.TextEncoder(split_at, tuple(added), lambda piece: machine.encode(tokens.spelled(piece)), whole, CHUNKS, PIECES)
    return machine, encoder


ENCODED = "doc_id long, n_tokens long, ids binary"


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every whole text; ids as unsigned 32-bit bytes.

    A null text is an empty one and has no ids. One output row per input row, repeated
    rows and null ids included; an empty table gives an empty one. Further columns are
    left out, whatever their names. A word of any length takes time in proportion. No
    shuffle.
    """

    def run(batches):
        import pyarrow as pa

        _, encoder = compiled(path)
        for batch in batches:
            for part in shingles.slices(batch, 1):
                ids = [encoder(x or b"") for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return id_text(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from rows of :func:`encode`."""

    def run(batches):
        import pyarrow as pa

        machine, _ = compiled(path)
        for batch in batches:
            texts = [machine.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode and digest every whole text in one pass.

    ``ids_sha256`` is over the decimal ids joined by one space, ``decoded_sha256``
    over the decoded text; both of an empty string where a text is null, empty or blank.
    Rows are as in :func:`encode`.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa

        machine, encoder = compiled(path)
        number = [str(i) for i in range(len(machine.label))]
        for batch in batches:
            for part in shingles.slices(batch, 1):
                rows = []
                for x in part.column(1).cast(pa.binary()).to_pylist():
                    ids = np.frombuffer(encoder(x or b""), "<u4").tolist()
                    rows.append((len(ids), hashlib.sha256(" ".join(map(number.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(machine.decode(ids).encode()).hexdigest()))
                n, a, b = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
