"""Secret scans: exact patterns, and weak parts that are linked where they meet.

Strong kinds are found by pattern alone. Weak parts (an account name, a random
looking word, an address) mean little on their own. They are roles of one
credential; a weak part is reported only if the parts that complete it stand in
the same scope. A scope is a paragraph (between blank lines), and within it a
reach of ``REACH`` code points on both sides: an interval join of the parts'
spans, done by sorted starts and binary search, so that no pairs are formed.

* identifier: completed by a secret;
* secret: completed by an identifier;
* endpoint: completed by an identifier and a secret.

Strong ``access`` spans are identifiers, strong ``assign`` and ``hex`` spans are
secrets when it comes to completing others.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchloom.llm import shingles, tokens
from pitchloom.llm.common import id_text

REACH = 200
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
MASK = "[secret]"

# Fixed patterns of the strong kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
NAMED = ("access", "client", "account", "user", "login", "tenant")
IDENTIFIER = re.compile(r"""\b(?:access_?key(?:_?id)?|client_?id|account(?:_?id)?|user_?(?:name|id)?|login|tenant(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?:https?|wss?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ftp)://[^\s"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?""", re.I | re.A)
BLANK_LINE = re.compile(r"\n[^\S\n]*\n")


def strong(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the strong kinds, leftmost and without overlap within a kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


class _Parts:
    """Spans of one role; tells whether one of them meets an interval."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends, most = [], -1
        for _, b in spans:
            most = max(most, b)
            self.ends.append(most)

    def meet(self, low: int, high: int) -> bool:
        """Any span with start < high and end > low."""
        at = bisect_left(self.starts, high)
        return at > 0 and self.ends[at - 1] > low


def linked(text: str, base: list[tuple[int, str, int]], reach: int = REACH) -> list[tuple[int, str, int]]:
    """Weak parts that are completed within their scope; none overlaps a strong span."""
    low = text.lower()
    if not any(k == "access" for _, k, _ in base) and not any(w in low for w in NAMED):
        return []
    taken = _Parts([(a, b) for a, _, b in base])
    free = lambda a, b: not taken.meet(a, b)
    names = [(m.start(1), m.end(1)) for m in IDENTIFIER.finditer(text)]
    weak = {"identifier": [s for s in names if free(*s)]}
    if not names and not any(k == "access" for _, k, _ in base):
        return []
    named = set(names)
    weak["secret"] = [s for s in (m.span() for m in RANDOM.finditer(text)) if free(*s) and s not in named]
    weak["endpoint"] = [s for s in (m.span() for m in ENDPOINT.finditer(text)) if free(*s)]
    role = {"identifier": _Parts(weak["identifier"] + [(a, b) for a, k, b in base if k == "access"]), "secret": _Parts(weak["secret"] + [(a, b) for a, k, b in base if k != "access"])}
    needs = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}
    walls = [m.start() for m in BLANK_LINE.finditer(text)] if any(weak.values()) else []
    out = []
    for kind, spans in weak.items():
        for a, b in spans:
            k = bisect_right(walls, a)
            left, right = max(a - reach, walls[k - 1] if k else 0), min(b + reach, walls[k] if k < len(walls) else len(text))
            if all(role[r].meet(left, right) for r in needs[kind]):
                out.append((a, kind, b))
    return out


def spans(text: str | None) -> list[tuple[int, str, int]]:
    """All spans of a text, by start, then kind in the order of ``KINDS``; null is empty."""
    if not text:
        return []
    base = strong(text)
    return sorted(base + linked(text, base), key=lambda s: (s[0], KINDS.index(s[1])))


def written(found: list[tuple[int, str, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for a, k, b in found])


def redacted(text: str, found: list[tuple[int, str, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by one mask."""
    out, at = [], 0
    for a, _, b in sorted(found):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end>>`` per row, in code points; no shuffle.

    A null or empty text has no spans. Repeated rows and null ids have their rows, an
    empty table none; texts of any length are taken whole. Further columns are left out,
    whatever their names.
    """

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in shingles.slices(batch, 1):
                found = [[{"kind": k, "start": a, "end": b} for a, k, b in spans(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return id_text(docs).mapInArrow(tokens.gives_back(run), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts and digests per document from rows of :func:`scan`."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", *map(count, KINDS[:3]), F.sha2(F.concat_ws(",", F.transform(base, said)), 256).alias("base_sha256"), F.concat_ws(",", F.transform("spans", said)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` masked, and ``n_chars`` (if it is there) counted anew.

    All other columns and all rows are kept; null texts stay null.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in shingles.slices(batch, at):
                texts = [t and redacted(t, spans(t)) for t in part.column(at).to_pylist()]
                yield part.set_column(at, "text", pa.array(texts, pa.string()))

    plain = docs.withColumn("text", F.col("text").cast("string"))
    at = plain.columns.index("text")
    out = plain.mapInArrow(tokens.gives_back(run), plain.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
