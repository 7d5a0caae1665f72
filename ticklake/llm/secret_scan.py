"""Secret scans: known key forms, and sliding-window Shannon entropy over candidate strings.

A candidate is a maximal run of letters, digits and + / _ = -. A window of fixed width slides over it; the sum of
c*log2(c) over the window's character counts is kept up by one step out and one step in, so that the entropy of
every window costs constant time. The threshold depends on the candidate's character class (hexadecimal, letters and
digits, base64). Windows at or above it are joined into spans, less what known forms cover, unless the allow-list
knows the span.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPANS, arrow_limits, by_batches, joined, span_array, texts

#: The forms of known keys, in the order in which ties are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits per character that a window must reach, by class.
THRESHOLDS = {"hex": 3.2, "alnum": 3.6, "base64": 3.9}
#: Strings that are no secrets, however mixed they look.
ALLOW = (r"(?i)example|placeholder|changeme|dummy|sample|redacted|your[_-]", r"(?i)abcdefgh|12345678|qwerty", r"(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$", r"^[/A-Za-z_-]*/[/A-Za-z_-]*$", r"(.)\1{7}")


def char_class(s: str) -> str | None:
    """hex, alnum, base64, or None for strings of letters or digits alone, which are words and numbers."""
    letters, digits = re.search("[A-Za-z]", s), re.search("[0-9]", s)
    if not (letters and digits):
        return None
    if re.fullmatch("[0-9a-f-]+|[0-9A-F-]+", s):
        return "hex"
    return "alnum" if re.fullmatch("[A-Za-z0-9]+", s) else "base64"


def entropy_windows(s: str, width: int, least: float) -> list[tuple[int, int]]:
    """Joined windows of s whose Shannon entropy is at least that many bits; counts are updated, not recounted."""
    if len(s) < width:
        return []
    cost = [0.0] + [c * log2(c) for c in range(1, width + 2)]
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    most = width * (log2(width) - least) + 1e-9
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        total += cost[c + 1] - cost[c]
        counts[ch] = c + 1
        if i >= width:
            out = s[i - width]
            c = counts[out]
            total += cost[c - 1] - cost[c]
            counts[out] = c - 1
        start = i - width + 1
        if start >= 0 and total <= most:
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


class Scanner:
    def __init__(self, window: int = WINDOW, thresholds: dict[str, float] | None = None, allow: tuple[str, ...] = ALLOW):
        self.window, self.thresholds, self.allow = window, thresholds or THRESHOLDS, [re.compile(a) for a in allow]

    def base(self, text: str) -> list[tuple[str, int, int]]:
        """Known forms; the least length is part of the pattern only where that cannot move a later match."""
        found = []
        if "=" in text or ":" in text:
            found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 12]
        if "AKIA" in text:
            found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
        return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]

    def mixed(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """High-entropy spans without what base spans cover; what is left of a span beside one counts from a window on.

        The allow-list is held against each span and, for forms of a whole string, against the whole candidate.
        """
        found = []
        starts, ends = joined(base)
        for m in CANDIDATE.finditer(text):
            s = m.group()
            kind = char_class(s)
            if kind is None or any(a.fullmatch(s) for a in self.allow):
                continue
            for a, b in entropy_windows(s, self.window, self.thresholds[kind]):
                for a, b in self._outside(a + m.start(), b + m.start(), starts, ends):
                    if not any(p.search(text[a:b]) for p in self.allow):
                        found.append(("entropy", a, b))
        return found

    def _outside(self, a: int, b: int, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
        """The parts of a span between what base spans cover (see joined()), of a window's length at least if it was cut."""
        i = bisect_left(ends, a + 1)  # the first covered part that ends after a
        if i == len(starts) or starts[i] >= b:
            return [(a, b)]
        parts = []
        while i < len(starts) and starts[i] < b:
            if starts[i] - a >= self.window:
                parts.append((a, starts[i]))
            a = max(a, ends[i])
            i += 1
        if b - a >= self.window:
            parts.append((a, b))
        return parts

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        base = self.base(text)
        order = {k: i for i, k in enumerate((*KINDS, "entropy"))}
        return sorted(base + self.mixed(text, base), key=lambda s: (s[1], order[s[0]]))


def find_secrets(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans, an array of (kind, start, end) in code points, by start and then kind; the whole text is read.

    Kinds assign, access and hex are known forms; entropy is what the sliding window adds. A null or empty text has
    no spans; rows with equal or null ids each get a row; an empty table gives an empty result; other columns are
    not read.
    """
    arrow_limits(docs.sparkSession)
    scanner = scanner or Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), span_array([scanner.scan(t) for t in texts(b)])], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)
