"""Secret scans with multipart linking.

Base spans (leftmost, not overlapping, per kind): ``assign`` key = value pairs whose value has 6 characters or
more, ``access`` identifiers AKIA... of 20 or more, ``hex`` runs of 24 or more.

Linking adds spans. Parts of a credential that are too weak to report alone are collected as intervals with
a role: *id* (user or account names given to a key, access identifiers), *secret* (values of password-like
keys too short for the base rule or with other characters, mixed tokens of 40 characters, credentials inside
a URL) and *endpoint* (URLs with a scheme for a data store or service, host settings). A scope is a paragraph
(blank line to blank line); inside it, intervals join if they lie within ``reach`` code points of one
another. A weak secret is reported (kind ``linked``) only if an access identifier, or an id and an endpoint, or
an id and a base span of another kind are within its reach - that is, only where complementary parts co-occur.
The nearest part of each role on either side decides, found by its sorted starts and ends; no pairs are listed.

Everything is decided within one text, so documents are only mapped. Offsets are code points, ends exclusive.

Cases: null text is empty and has no spans; repeated rows give repeated rows; texts of any length are scanned
whole; empty tables give empty results.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import slices

REACH = 300
MIN_VALUE = 6

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "linked")
_KEYS = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.I | re.A)

#: The scheme of a URL, from the beginning of its run of characters; runs are possessive, so each is read once.
_SCHEME = r"(?<![a-z0-9+.-])[a-z0-9+.-]++://"
_NAMED = r"""(?<![A-Za-z0-9])(?:%s)["']?\x20*[:=]\x20*["']?(%s)"""

#: Weak parts, each with its role; group 1 is the span. Nothing limits the length of a part.
WEAK = (
    ("id", re.compile(_NAMED % ("user(?:name)?|login|account(?:_id)?|client_?id|access_?key_?id", "[A-Za-z0-9@._+-]{3,}+"), re.I | re.A)),
    ("secret", re.compile(_NAMED % ("pass(?:wor)?d?|pwd|secret|token|api_?key|private_?key|client_?secret", "[!-~]{4,}+"), re.I | re.A)),
    ("secret", re.compile(r"(?<![A-Za-z0-9/+])([A-Za-z0-9/+]{40})(?![A-Za-z0-9/+=])")),
    ("secret", re.compile(_SCHEME + r"[^\s/:@]++:([^\s/:@]{3,}+)@", re.A)),
    ("id", re.compile(_SCHEME + r"([^\s/:@]++):[^\s/:@]{3,}+@", re.A)),
    ("endpoint", re.compile(r"(?<![A-Za-z0-9])(?:(?:jdbc:[a-z]++|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|ftps?|sftp|ldaps?|s3)://)(?:[^\s/@]++@)?([^\s\"'<>@]{3,}+)", re.A)),
    ("endpoint", re.compile(_SCHEME + r"[^\s/:@]++:[^\s/:@]{3,}+@([^\s\"'<>/]{3,}+)", re.A)),
    ("endpoint", re.compile(_NAMED % ("host(?:name)?|server|endpoint|base_?url|region", "[A-Za-z0-9._:/-]{3,}+"), re.I | re.A)),
)
#: A text without any of these strings (lower case) has no id, and nothing is linked without one.
_HINTS = ("://", "akia", "user", "login", "account", "client", "access", "host", "server", "endpoint", "url", "region")
_SCOPE = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    found = []
    if _KEYS.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def linked_spans(text: str, base: list[tuple[int, int, int]], reach: int = REACH) -> list[tuple[int, int, int]]:
    """Weak secrets that an access identifier, or an id and a further part, back up within their scope and reach."""
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return []
    parts: dict[str, list[tuple[int, int]]] = {"id": [], "secret": [], "endpoint": [], "base": []}
    for role, pattern in WEAK:
        parts[role] += [m.span(1) for m in pattern.finditer(text)]
    if not parts["secret"] or not (parts["id"] or any(kind == 1 for _, kind, _ in base)):
        return []
    parts["access"] = [(s, e) for s, kind, e in base if kind == 1]
    parts["id"] += parts["access"]
    parts["base"] = [(s, e) for s, kind, e in base if kind != 1]
    cuts = [m.end() for m in _SCOPE.finditer(text)]
    for spans in parts.values():
        spans.sort()
    starts = {role: [s for s, _ in spans] for role, spans in parts.items()}
    ends = {role: sorted(e for _, e in spans) for role, spans in parts.items()}

    def near(role: str, start: int, end: int) -> bool:
        """A part of that role beside the span, in the same scope and within reach."""
        scope = bisect.bisect_right(cuts, start)
        lo, hi = (cuts[scope - 1] if scope else 0), (cuts[scope] if scope < len(cuts) else len(text))
        before, after = bisect.bisect_right(ends[role], start) - 1, bisect.bisect_left(starts[role], end)
        return (before >= 0 and ends[role][before] > max(lo, start - reach)) or (after < len(parts[role]) and starts[role][after] < min(hi, end + reach))

    taken, tops = [s for s, _, _ in base], list(itertools.accumulate((e for _, _, e in base), max))
    out = set()
    for start, end in parts["secret"]:
        k = bisect.bisect_left(taken, end)
        if k and tops[k - 1] > start:
            continue  # a base span reports it already
        if near("access", start, end) or near("id", start, end) and (near("endpoint", start, end) or near("base", start, end)):
            out.add((start, 3, end))
    return sorted(out)


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row for each document: counts and digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            base, every = [], []
            for text in part.column("text").to_pylist():
                found = base_spans(text or "")
                base.append(found)
                every.append(sorted(found + linked_spans(text or "", found, reach)))
            counts = [pa.array([sum(k == kind for _, k, _ in found) for found in base], pa.int64()) for kind in range(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    *counts,
                    pa.array([hashlib.sha256(_named(f).encode()).hexdigest() for f in base], pa.string()),
                    pa.array([_named(f) for f in every], pa.string()),
                    pa.array([len(f) - len(b) for f, b in zip(every, base)], pa.int64()),
                ],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
            )

    kind = documents.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    return documents.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
