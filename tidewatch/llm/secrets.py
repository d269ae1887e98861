"""Operator 6, secret scan with multipart credential linking.

Strong parts are found by their form alone: assignments, access identifiers and
long hexadecimal runs. Weak candidates, strings that only look random, say little
alone. They are reported as ``weak`` if a complementary part, an access identifier
or an endpoint, stands in the same scope; that is an interval join on the sorted
parts of the text. A scope is a paragraph, or with ``reach`` the characters of the
paragraph within that distance. ``links`` lists each secret with the nearest access
identifier and endpoint of its scope, ``scopes`` all access identifiers, secrets
and endpoints of every paragraph that has a linked secret, so it grows with the
parts and not with their pairs.

Null texts count as empty and have no spans. Offsets are code points, ends
exclusive. Repeated rows give repeated results, texts may have any length, and
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

# The patterns and least lengths of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "weak")
# Parts of the linking step.
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9/._-]*|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?![0-9.])", re.ASCII)
REACH = 300

Span = tuple[int, int]


def base_spans(text: str) -> dict[str, list[Span]]:
    """The spans of each strong kind, in order."""
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN],
        "access": [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def opaque_spans(text: str, taken: list[Span]) -> list[Span]:
    """Random-looking strings of mixed signs that no strong span touches."""
    starts = [a for a, _ in taken]
    reach = []  # the furthest end of the spans so far
    for _, b in taken:
        reach.append(max(b, reach[-1] if reach else 0))
    out = []
    for m in OPAQUE.finditer(text):
        s = m[0]
        if not (any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s)):
            continue
        k = bisect_left(starts, m.end())
        if k and reach[k - 1] > m.start():
            continue
        out.append(m.span())
    return out


def nearest(span: Span, others: list[Span], low: int, high: int, reach: int | None = REACH) -> Span | None:
    """The closest of sorted, disjoint spans within reach (None: any distance) and within low..high."""
    best, gap = None, (high - low if reach is None else reach) + 1
    k = bisect_right(others, span)
    for other in others[max(0, k - 1) : k + 1]:
        away = max(other[0] - span[1], span[0] - other[1], 0)
        if low <= other[0] and other[1] <= high and away < gap:
            best, gap = other, away
    return best


def endpoint_spans(text: str) -> list[Span]:
    return [m.span() for m in ENDPOINT.finditer(text)] if ("://" in text or "." in text) else []


def paragraphs(text: str) -> list[int]:
    """Where blank lines separate paragraphs."""
    return [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]


def scan(text: str, reach: int | None = REACH) -> tuple[dict[str, list[Span]], list[tuple[Span, Span, Span | None]]]:
    """All spans by kind, and linked (access, secret, endpoint) parts."""
    spans = base_spans(text)
    endpoints = endpoint_spans(text)
    access = spans["access"]
    spans["weak"], links = [], []
    if not access and not endpoints:
        return spans, links
    strong = sorted(spans["assign"] + spans["hex"])
    weak = opaque_spans(text, sorted(strong + access + endpoints))
    breaks = paragraphs(text)
    for kind, found in (("strong", strong), ("weak", weak)):
        for span in found:
            k = bisect_right(breaks, span[0])
            low, high = breaks[k - 1] if k else 0, breaks[k] if k < len(breaks) else len(text)
            key, place = nearest(span, access, low, high, reach), nearest(span, endpoints, low, high, reach)
            if kind == "weak" and (key or place):
                spans["weak"].append(span)
            if key:
                links.append((key, span, place))
    return spans, links


def scopes(text: str, spans: dict[str, list[Span]], links: list[tuple[Span, Span, Span | None]]) -> list[tuple[list[Span], ...]]:
    """Access identifiers, secrets and endpoints of each paragraph with a link, in order."""
    if not links:
        return []
    breaks = paragraphs(text)
    of = lambda span: bisect_right(breaks, span[0])
    found: dict[int, tuple[list[Span], ...]] = {of(secret): ([], [], []) for _, secret, _ in links}
    secrets = sorted(spans["assign"] + spans["hex"] + spans["weak"])
    for k, parts in enumerate((spans["access"], secrets, endpoint_spans(text))):
        for span in parts:
            if of(span) in found:
                found[of(span)][k].append(span)
    return [found[k] for k in sorted(found)]


def listing(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    found = sorted((a, kinds.index(kind), b) for kind in kinds for a, b in spans[kind])
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found)


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text: str = "text", reach: int | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak, links, scopes of every row."""
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].alias("text"))

    def work(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                spans, links = scan(text or "", reach)
                base = listing(spans, KINDS[:3])
                linked = [f"{k[0]}:{k[1]}-{s[0]}:{s[1]}-" + (f"{p[0]}:{p[1]}" if p else "") for k, s, p in links]
                together = ";".join("|".join(",".join(f"{a}:{b}" for a, b in part) for part in scope) for scope in scopes(text or "", spans, links))
                out.append((*(len(spans[k]) for k in KINDS[:3]), hashlib.sha256(base.encode()).hexdigest(), listing(spans, KINDS), len(spans["weak"]), ",".join(linked), together))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_weak", "links", "scopes"],
            )

    return rows.mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_weak long, links string, scopes string")
