"""Operator 7, secret scans: fixed patterns and sliding-window entropy.

Base kinds are matched as given, leftmost and not overlapping within a kind. The method
adds spans of kind ``entropy``: in every run of 20 or more token characters a window of
20 slides by one character at a time; counts of its characters, and with them the sum
of c * log2(c), change by one character in and one out, so each step costs the same
whatever the window. A window is judged by its character class, each with a threshold of
its own: hex digits, letters and digits of one case, full base64, letters of both cases,
and letters of one case, where only windows of almost all different letters count, as
words come close. Windows of digits alone are never judged: numbers are not secrets.
Windows over their threshold that overlap make one span. A window that a match of the
allow-list touches is left out; the rest of its run is still judged, and base spans stay.

Positions count code points, ends are exclusive. Defined results: null and empty texts
have no spans (the hash is that of the empty string); repeated rows repeat; an empty
table gives no rows; other columns, whatever their names, are ignored. Texts of any
length are scanned whole, in linear time, a run of about 1 MB of texts at once.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from colloquy.sources.scratch import ship

from . import bytesplit as bs
from .common import table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The runs of hex digits of 16 or more: a run is tried from its start, so shorter ones give nothing.
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

WINDOW = 20
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
#: Thresholds in bits by class; the most that 20 characters can have is 4.32.
THRESHOLDS = {"hex": 2.9, "one_case": 3.5, "base64": 3.7, "letters": 4.0, "one_case_letters": 4.15}
#: What is no secret wherever it stands in a run: documented sample keys, words joined by marks, dates, names of digests, repeated rules.
ALLOW = (r"(?i)[a-z0-9]*example[a-z0-9]*", r"(?<![A-Za-z0-9])[A-Za-z]{1,15}(?:[-_/=+]+[A-Za-z]{1,15})+(?![A-Za-z0-9])", r"(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])", r"(?i)(?<![a-z0-9])sha(?:1|256|384|512)[-=][a-z0-9+/]+", r"[-_=+/]{4,}")

_HEX, _DIGIT, _LOWER, _UPPER = (frozenset(x) for x in ("0123456789abcdefABCDEF", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_LOG = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]


def window_entropies(run: str) -> Iterator[tuple[int, str | None, float]]:
    """Start, class (None: not judged) and entropy of every window of a run."""
    counts: dict[str, int] = {}
    sums, n_digit, n_lower, n_upper, n_hex = 0.0, 0, 0, 0, 0
    for k, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        sums += _LOG[n + 1] - _LOG[n]
        n_digit, n_lower, n_upper, n_hex = n_digit + (c in _DIGIT), n_lower + (c in _LOWER), n_upper + (c in _UPPER), n_hex + (c in _HEX)
        if k < WINDOW - 1:
            continue
        kind = None
        if n_digit and n_lower + n_upper:
            kind = "hex" if n_hex == WINDOW else "base64" if n_lower and n_upper else "one_case"
        elif n_lower + n_upper:
            kind = "letters" if n_lower and n_upper else "one_case_letters"
        yield k - WINDOW + 1, kind, math.log2(WINDOW) - sums / WINDOW
        c = run[k - WINDOW + 1]
        n = counts[c]
        counts[c] = n - 1
        sums += _LOG[n - 1] - _LOG[n]
        n_digit, n_lower, n_upper, n_hex = n_digit - (c in _DIGIT), n_lower - (c in _LOWER), n_upper - (c in _UPPER), n_hex - (c in _HEX)


def _allowed(run: str, allow: tuple[re.Pattern, ...]) -> list[tuple[int, int]]:
    """Stretches of a run that the allow-list covers, in order."""
    return sorted(m.span() for p in allow for m in p.finditer(run))


def entropy_spans(text: str, allow: tuple[str, ...] = ALLOW, thresholds: dict[str, float] | None = None) -> list[tuple[int, int]]:
    thresholds = thresholds or THRESHOLDS
    allow = tuple(map(re.compile, allow))
    out: list[tuple[int, int]] = []
    for m in RUN.finditer(text):
        run = m.group()
        covered, open_, upto = _allowed(run, allow), None, 0
        k = 0
        for at, kind, h in window_entropies(run):
            # stretches that begin before the window's end reach as far as ``upto``
            while k < len(covered) and covered[k][0] < at + WINDOW:
                upto, k = max(upto, covered[k][1]), k + 1
            if kind and h > thresholds[kind] and upto <= at:
                open_ = (open_[0] if open_ else at, at + WINDOW)
            elif open_ and at >= open_[1]:
                out.append((m.start() + open_[0], m.start() + open_[1]))
                open_ = None
        if open_:
            out.append((m.start() + open_[0], m.start() + open_[1]))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) by start and kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    for batch in batches:
        for first, texts in bs.pieces(batch.column(1)):
            rows = []
            for raw in texts:
                t = raw.decode()
                base = base_spans(t)
                more = [(a, 3, b) for a, b in entropy_spans(t)]
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_line(base).encode()).hexdigest(), _line(sorted(base + more)), len(more)))
            cols = (pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *cols], names)
    bs.trim()


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy for every row, without a shuffle."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
