"""Secret scans: strong patterns on their own, weak parts only when complementary parts stand near.

Access identifiers, secrets and endpoints are parts with intervals. Within a scope (a document, and in it
intervals at most ``REACH`` code points apart) they are joined by a sweep over the sorted intervals; a weak
candidate is reported only if the join gives it a part of another role. Each document is swept once in
time and memory linear in its parts, so nothing is shuffled and no pairs are listed.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 200
"""Most code points between two parts that can belong to one credential."""

BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ia)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

# Parts that count only together with a part of another role.
_WEAK = (
    ("id", "client_id", re.compile(r"""(?ia)\b(?:client_?id|account|user(?:name)?|login|app_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""")),
    ("secret", "short_secret", re.compile(r"""(?ia)\b(?:pwd|pass|auth|credential|private_?key|signing_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""")),
    ("secret", "random", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/_=-])")),
    ("endpoint", "endpoint", re.compile(r"(?a)\b(?:https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|s3)://[A-Za-z0-9._~:@/-]{4,}")),
)
_DIGIT = re.compile("[0-9]")  # an unlabelled random part has one at least
_HINT = re.compile(r"(?ia)client_?id|account|user|login|app_?id|key_?id|pwd|pass|auth|credential|private_?key|signing_?key|AKIA|://|token|secret|api_?key")
ROLE = {"assign": "secret", "hex": "secret", "access": "id"}
MIN_ENTROPY = 4.0
"""Bits a character of an unlabelled random part, at least."""


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    role: str
    linked: str  # the roles that the join found beside it, sorted


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _base(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def _weak(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, str, int, int]]:
    if not _HINT.search(text):  # then no part could have a partner with a label
        return []
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    found = []
    for role, kind, pattern in _WEAK:
        for m in pattern.finditer(text):
            s, e = m.span()
            i = bisect_left(starts, e) - 1  # the last base span that starts before this one ends
            if i >= 0 and taken[i][1] > s or kind == "random" and (not _DIGIT.search(m.group()) or _entropy(m.group()) < MIN_ENTROPY):
                continue
            found.append((role, kind, s, e))
    return found


def _interval_join(parts: list[tuple[str, str, int, int]], reach: int) -> list[set[str]]:
    """For each part (sorted by start) the roles of the other roles' parts at most reach away: two sweeps that
    keep the furthest end, and the nearest start, seen of each role."""
    near: list[set[str]] = [set() for _ in parts]
    furthest: dict[str, int] = {}
    for i, (role, _, s, e) in enumerate(parts):
        near[i] |= {r for r, end in furthest.items() if r != role and s - end <= reach}
        furthest[role] = max(e, furthest.get(role, e))
    nearest: dict[str, int] = {}
    for i in reversed(range(len(parts))):
        role, _, s, e = parts[i]
        near[i] |= {r for r, start in nearest.items() if r != role and start - e <= reach}
        nearest[role] = s
    return near


def scan(text: str | None, reach: int = REACH) -> list[Span]:
    """All spans of a text, by start, then base kinds as listed, then the others."""
    text = text or ""
    base = _base(text)
    parts = sorted([(ROLE[k], k, s, e) for k, s, e in base] + _weak(text, base), key=lambda p: (p[2], p[3]))
    out = [Span(kind, s, e, role, "+".join(sorted(near))) for (role, kind, s, e), near in zip(parts, _interval_join(parts, reach)) if kind in BASE or near - {"endpoint"} or near and role != "endpoint"]
    return sorted(out, key=lambda x: (x.start, BASE.index(x.kind) if x.kind in BASE else len(BASE), x.kind, x.end))


def find(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end,role,linked>>): a row for each row of docs.

    A null text counts as empty and has no spans; repeated rows and null ids are kept; other columns are ignored.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("role", pa.string()), ("linked", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[vars(s) for s in scan(t.as_py(), reach)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,role:string,linked:string>>")


def report(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """The digest columns of find()."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    linked = F.size(F.filter("spans", lambda s: s["linked"] != "")).cast("long")
    return find(docs, reach).select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), linked.alias("n_linked"))
