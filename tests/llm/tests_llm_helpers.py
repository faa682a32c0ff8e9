"""Brute-force version of the pipeline's text stages."""

import re

from pitchloom.llm import secrets

BLANK = "[^\x20\x09-\x0d]+"


def expected_pipeline(docs):
    """``doc_id -> text`` after near-duplicate, passage and secret stages; documents with letters count as identified."""
    texts = {int(i): t for i, t in zip(docs.doc_id, docs.text) if t and any(c.isalpha() for c in t)}
    sets = {}
    for i, t in sorted(texts.items()):
        w = re.findall(BLANK, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    first, out = {}, {}
    kept = [i for i in sets if root(i) == i]
    words = {i: [m.span() for m in re.finditer(BLANK, texts[i])] for i in kept}
    for i in kept:
        t, w = texts[i], words[i]
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(t[a:b] for a, b in w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        if any(gone):
            stops = [a for a, _ in w[1:]] + [len(t)]
            t = t[: w[0][0]] + "".join(t[a:s] for (a, _), s, g in zip(w, stops, gone) if not g)
        out[i] = secrets.redacted(t, secrets.spans(t))
    return out
