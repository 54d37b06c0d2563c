"""Secret scans with multipart credential linking.

Three kinds stand alone: assignments, access key ids and long hexadecimal runs. Weak kinds
(user names, mixed-letter blobs, endpoints) mean little by themselves. Each part is an interval
with a role, joined to the scope that holds it: a paragraph, from one blank line to the next,
however long. A weak part is reported only when parts of complementary roles lie in its scope: an
identifier needs a secret, a secret an identifier or an endpoint, and an endpoint both or a
strong one of them. Scopes keep what roles they hold, so no pairs are listed. The parts of a
scope that links are one credential.

Defined results: null and empty texts have no spans; offsets are code points; texts of any length are
scanned whole, and so are scopes; repeated rows give equal rows; spans of different kinds may overlap;
an empty table gives no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import give_back, table

KINDS = ("assign", "access", "hex", "user", "blob", "endpoint")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_USER = re.compile(r"""\b(?:user(?:_?name|_?id)?|login|client_?id|account(?:_?id)?|access_?(?:key_?)?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.IGNORECASE | re.ASCII)
_BLOB = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{24,}={0,2}")
_ENDPOINT = re.compile(r"\b(?:[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5})", re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the kinds that stand alone, leftmost and non-overlapping within each."""
    out = []
    low = text.lower()
    if (":" in text or "=" in text) and any(n in low for n in _NAMES):
        out += [(0, *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(2, *m.span()) for m in _HEX.finditer(text)]
    return out


#: The roles of kinds in a credential: a strong identifier or secret stands alone, a weak one does not.
IDENTIFIERS, SECRETS, STRONG, ENDPOINTS = (1, 3), (0, 2, 4), (0, 1, 2), (5,)
_BLANK_LINE = re.compile(r"\n[ \t]*\n")


def linked(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], list[list[tuple[int, int, int]]]]:
    """Weak parts that complementary parts of their scope confirm, and the parts of each scope that links."""
    users = [(3, *m.span()) for m in _USER.finditer(text)] if ":" in text or "=" in text else []
    ends = [(5, *m.span()) for m in _ENDPOINT.finditer(text)] if ":" in text else []
    if not (users or ends or any(b[0] == 1 for b in base)):
        return [], []
    blobs = []
    for m in _BLOB.finditer(text):
        s = m[0]
        if any(map(str.isupper, s)) and any(map(str.islower, s)) and any(map(str.isdigit, s)) and not s.startswith("AKIA"):
            blobs.append((4, *m.span()))
    breaks = [m.start() for m in _BLANK_LINE.finditer(text)]
    scopes: dict[int, list[tuple[int, int, int]]] = {}
    for part in [*base, *users, *blobs, *ends]:
        scopes.setdefault(bisect_right(breaks, part[1]), []).append(part)
    weak, credentials = [], []
    for _, parts in sorted(scopes.items()):
        held = Counter(k for k, _, _ in parts)
        at = {(s, e, k) for k, s, e in parts}

        def has(kinds: tuple[int, ...], own: tuple[int, int, int]) -> bool:
            """A part of these kinds other than one at the very same place."""
            same = sum((own[1], own[2], k) in at for k in kinds)  # noqa: B023
            return sum(held[k] for k in kinds) > same  # noqa: B023

        found = []
        for part in parts:
            secret, identifier = has(SECRETS, part), has(IDENTIFIERS, part)
            if part[0] == 3 and secret or part[0] == 4 and (identifier or has(ENDPOINTS, part)) or part[0] == 5 and (secret and identifier or has(STRONG, part)):
                found.append(part)
        if found:
            weak += found
            credentials.append(sorted([p for p in parts if p[0] in STRONG] + found, key=_by_place))
    return weak, credentials


def _by_place(x: tuple[int, int, int]) -> tuple[int, int, int]:
    return x[1], x[0], x[2]


def linked_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that complementary parts confirm."""
    return linked(text, base)[0]


def scan(text: str | None) -> tuple[list, list]:
    """Spans that stand alone and linked ones, each by start and then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    return sorted(base, key=_by_place), sorted(linked_spans(text, base), key=_by_place)


def span_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, start, end, linked) for each span found in a text column."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(k, KINDS[s[0]], s[1], s[2], n == 1) for k, t in zip(pdf["key"], pdf["text"], strict=True) for n, spans in enumerate(scan(t)) for s in spans]
            yield pd.DataFrame(rows, columns=["key", "kind", "start", "end", "linked"])

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInPandas(run, f"key {kind}, kind string, start long, end long, linked boolean")


def mask_text(text: str | None) -> str | None:
    """The text with every span's characters replaced by its kind in brackets."""
    if not text:
        return text
    base, more = scan(text)
    if not base and not more:
        return text
    out, at = [], 0
    for kind, start, end in sorted([*base, *more], key=lambda x: (x[1], x[0], -x[2])):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``credentials``: the parts of each scope that links, scopes apart by a bar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py() or ""
                base = sorted(base_spans(text), key=_by_place)
                more, credentials = linked(text, base)
                rows.append((base, sorted([*base, *more], key=_by_place), credentials))
            counts = [pa.array([sum(s[0] == k for s in r[0]) for r in rows], pa.int64()) for k in range(3)]
            digest = pa.array([hashlib.sha256(_written(r[0]).encode()).hexdigest() for r in rows], pa.string())
            spans, whole = pa.array([_written(r[1]) for r in rows], pa.string()), pa.array(["|".join(map(_written, r[2])) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, spans, whole], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "credentials"])

    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, credentials string")


def mask(docs: DataFrame) -> DataFrame:
    """The rows of docs with every span found in ``text`` masked; ``n_chars``, if there, follows."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def masked(texts):
        out = texts.map(mask_text, na_action="ignore")
        give_back()
        return out

    out = docs.withColumn("text", masked(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
