"""Secret scan with multipart credential linking.

Three strong kinds are reported wherever they match (``assign``, ``access``, ``hex``). Three weak
kinds would be noise on their own: an ``identifier`` (``client_id = ...``), an ``opaque`` mixed
token and an ``endpoint``. They are reported only when complementary parts co-occur: an interval
join inside each scope (a block between blank lines) asks whether a part of the needed role lies
within ``scope_chars`` code points beside it. No part supports itself: what overlaps a candidate, such as a token
inside its own assignment or URL, is no complement of it.

    identifier   needs a secret (assign, hex, opaque)
    opaque       needs an identifier (access, identifier)
    endpoint     needs both

Scopes never leave a document, so the join is a sorted sweep in the row's own task: the scan is
one narrow pass without a shuffle, and a text of any length costs n log n of its few parts.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.llm.worker import give_back

# The three base patterns, with the least length of a value, and the kinds in their order.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("identifier", "opaque", "endpoint")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

IDENTIFIER = re.compile(r"\b(?:access|account|app|client|key|tenant|user)[_-]?(?:key[_-]?)?(?:id|name)[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?([A-Za-z0-9@_.-]{6,})", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])", re.A)
ENDPOINT = re.compile(r"\b(?:https?|s3|gs|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+", re.I | re.A)
BLANK_LINE = re.compile(r"\n[ \t]*\n")

SPANS = "array<struct<kind:string,start:long,end:long>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Strong spans of a whole text. ``{16,}`` and ``{24,}`` match the same maximal runs as ``+`` with the
    short ones dropped; ``assign`` can consume a value that is then dropped, so it is filtered after."""
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def _near(parts: list[tuple[int, int]], spans: list[tuple[str, int, int]], reach: int) -> list[bool]:
    """For each span: does some part beside it, not overlapping it, lie within ``reach`` code points? A part that ends
    or one that starts in reach is found in the sorted ends and starts."""
    starts, ends = sorted(p[0] for p in parts), sorted(p[1] for p in parts)
    return [bisect_left(ends, s - reach) < bisect_right(ends, s) or bisect_left(starts, e) < bisect_right(starts, e + reach) for _, s, e in spans]


def linked_spans(text: str, base: list[tuple[str, int, int]], scope_chars: int) -> list[tuple[str, int, int]]:
    """Weak spans that complementary parts support. A weak span that overlaps a base span is not a candidate."""
    weak: list[tuple[str, int, int]] = []
    if ":" in text or "=" in text:
        weak += [("identifier", *m.span()) for m in IDENTIFIER.finditer(text)]
    ids = [x for x in weak if x[0] == "identifier"]
    if not ids and not any(k == "access" for k, _, _ in base):
        return []  # opaque and endpoint both need an identifier
    weak += [("opaque", *m.span()) for m in OPAQUE.finditer(text) if _mixed(m[0])]
    if "://" in text:
        weak += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    taken = sorted((s, e) for _, s, e in base)
    starts, far, top = [t[0] for t in taken], [], -1
    for t in taken:
        top = max(top, t[1])
        far.append(top)
    weak = [w for w in weak if not ((k := bisect_left(starts, w[2]) - 1) >= 0 and far[k] > w[1])]
    cuts = [m.start() for m in BLANK_LINE.finditer(text)]
    scopes: dict[int, list[tuple[str, int, int]]] = {}
    for span in [*base, *weak]:
        scopes.setdefault(bisect_right(cuts, span[1]), []).append(span)
    found = []
    for spans in scopes.values():
        cands = [x for x in spans if x[0] in WEAK_KINDS]
        if not cands:
            continue
        by_id = _near([x[1:] for x in spans if x[0] in ("access", "identifier")], cands, scope_chars)
        by_secret = _near([x[1:] for x in spans if x[0] in ("assign", "hex", "opaque")], cands, scope_chars)
        need = {"identifier": lambda i, s: s, "opaque": lambda i, s: i, "endpoint": lambda i, s: i and s}
        found += [c for c, i, s in zip(cands, by_id, by_secret, strict=True) if need[c[0]](i, s)]
    return found


def spans_of(text: str | None, scope_chars: int) -> list[tuple[str, int, int]]:
    """All reported spans of a whole text by start, then kind (base kinds first); null counts as empty."""
    text = text or ""
    base = base_spans(text)
    rank = {k: n for n, k in enumerate((*BASE_KINDS, *WEAK_KINDS))}
    return sorted([*base, *linked_spans(text, base, scope_chars)], key=lambda x: (x[1], rank[x[0]], x[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope_chars: int = 240) -> DataFrame:
    """``id_col`` and ``secret_spans`` (array of kind, start, end; code points, end exclusive) for every row.

    Null or empty text: no spans. Repeated rows and null ids each keep their own row. Other columns of
    ``docs`` are not read, so their names cannot clash. Empty table: empty result."""
    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, scope_chars)])

    return docs.select(F.col(id_col), scan(F.col(text_col)).alias("secret_spans"))


def spans_text(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans (of these kinds), comma-joined in their order."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redact_secrets(docs: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars", scope_chars: int = 240) -> DataFrame:
    """``docs`` with every reported span replaced by ``[REDACTED]`` and the length column renewed; no row is
    dropped. Overlapping spans are replaced once. Null text stays null."""
    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for _, s, e in spans_of(text, scope_chars):
            if s >= at:
                out += [text[at:s], "[REDACTED]"]
            at = max(at, e)
        return "".join([*out, text[at:]]) if out else text

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text_col)
            yield b.set_column(i, text_col, pa.array([clean(t) for t in b.column(i).to_pylist()], pa.string()))
        give_back()

    out = docs.mapInArrow(redact, docs.schema)
    return out.withColumn(n_chars_col, F.length(text_col).cast(docs.schema[n_chars_col].dataType)) if n_chars_col in docs.columns else out
