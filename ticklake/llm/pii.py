"""Personal data: known forms, and what a conditional random field over word shapes adds; spans and masked texts."""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPANS, arrow_limits, by_batches, joined, span_array, texts
from .crf import CRF

#: The known forms, in the order in which ties are listed.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile("[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: The labels of the random field; O is none.
FIELDS = ("email", "ip", "card", "phone", "id")
def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches found from their at sign: the local part is the longest run before it that is still free."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def base(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def labelled_table(rows: int = 400, seed: int = 7) -> tuple[list[list[str]], list[list[str]]]:
    """The labelled table, made by a rule: invented words around personal data of each kind, and harmless numbers."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "th", "on", "re", "sh", "ou", "el", "qu", "ö", "é", "st", "in")) for _ in range(r.randint(1, 4)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    end = lambda: r.choice(("", "", ".", ",", "###", "***"))
    host = lambda: f"{word()}{r.choice(('', digits(1)))}.{r.choice(('com', 'org', 'net', 'de'))}"
    made = {
        "email": lambda: r.choice((f"{word()}@{host()}", f"{word()}.{digits(2)}@{word()}.{host()}", f"{word()} (at) {word()} (dot) com", f"{word()} [at] {word()} [dot] org")),
        "ip": lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)),
        "card": lambda: r.choice((digits(16), f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}")),
        "phone": lambda: r.choice((f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}")),
        "id": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
    }
    plain = [lambda: digits(r.randint(1, 4)), lambda: f"Version {r.randint(1, 9)}.0.", lambda: f"version {r.randint(1, 9)}.", lambda: f"BY-NC {r.randint(1, 4)}.0.", lambda: f"{r.randint(1, 300)},000", lambda: f"{r.randint(1, 99)}%", lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"${digits(2)}.{digits(2)}", lambda: f"password={''.join(r.choice('0123456789abcdef') for _ in range(18))}", lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', lambda: "AKIA" + "".join(r.choice("ABCDEFGHJKLM234567") for _ in range(16)), lambda: f"{r.randint(1, 12)}:{r.randint(10, 59)}", lambda: f"{word()}{digits(2)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: digits(r.randint(5, 8)), lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: "@" + word(), lambda: "(at) " + word()]
    cue = {"email": ("mail", "email:", "contact"), "ip": ("ip", "host", "server"), "card": ("card", "visa", "account"), "phone": ("phone", "call", "tel."), "id": ("ssn", "id", "passport")}
    sequences, tags = [], []
    for i in range(rows):
        words, labels = [], []

        def add(text: str, kind: str, words: list = words, labels: list = labels) -> None:
            for j, w in enumerate(text.split(" ")):
                words.append(w)
                labels.append("O" if kind == "O" else f"{'I' if j else 'B'}-{kind}")

        for _ in range(r.randint(1, 2)):
            for _ in range(r.randint(0, 6)):
                add((w := word()) if r.random() < 0.8 else w.capitalize() + end(), "O") if (w := word()) else None
            if i % 2:
                kind = r.choice(FIELDS)
                if r.random() < 0.4:
                    add(r.choice(cue[kind]), "O")
                add(made[kind]() + end(), kind)
            else:
                add(r.choice(plain)() + end(), "O")
        for _ in range(r.randint(0, 6)):
            add(word() + end(), "O")
        sequences.append(words)
        tags.append(labels)
    return sequences, tags


@cache
def fit(rows: int = 400, seed: int = 7) -> CRF:
    """The random field trained on the labelled table of so many rows."""
    return CRF(["O", *(f"{x}-{k}" for k in FIELDS for x in "BI")]).fit(*labelled_table(rows, seed))


WORD = re.compile(r"\S+")


class Finder:
    """Known forms, plus spans of the random field that touch none of them. A line of a text is a sequence; all are decoded."""

    def __init__(self, crf: CRF):
        self.crf = crf

    def find_batch(self, batch: list[str]) -> list[list[tuple[str, int, int]]]:
        found = [base(t) if ANY.search(t) else [] for t in batch]
        lines = [t.split("\n") for t in batch]
        owner = [(i, j) for i, x in enumerate(lines) for j in range(len(x))]
        tagged = self.crf.tagged([line.split() for x in lines for line in x])
        by_text: dict[int, list[tuple[int, dict[int, str]]]] = {}
        for n in sorted(tagged):
            i, j = owner[n]
            by_text.setdefault(i, []).append((j, tagged[n]))
        order = {k: i for i, k in enumerate((*KINDS, *(f"crf_{k}" for k in FIELDS)))}
        for i, own in by_text.items():
            starts, ends = joined(found[i])
            begin = list(accumulate((len(x) + 1 for x in lines[i]), initial=0))
            for j, tags in own:
                words = [m.span() for m in WORD.finditer(lines[i][j])]
                for first, last, kind in chunks(tags):
                    a, b = begin[j] + words[first][0], begin[j] + words[last][1]
                    a += len(batch[i][a:b]) - len(batch[i][a:b].lstrip("\"'[<,;:"))
                    b -= len(batch[i][a:b]) - len(batch[i][a:b].rstrip("\"'>.,;:!?#*$&%|"))
                    known = bisect_left(ends, a + 1)  # the first part that ends after the span starts
                    if a < b and not (known < len(starts) and starts[known] < b):
                        found[i].append((f"crf_{kind}", a, b))
        return [sorted(f, key=lambda s: (s[1], order[s[0]])) for f in found]


def chunks(tags: dict[int, str]) -> Iterator[tuple[int, int, str]]:
    """First and last word and kind of each run of a label with the I- labels of its kind after it."""
    held: tuple[int, int, str] | None = None
    for j in sorted(tags):
        kind = tags[j][2:]
        if held and held[1] == j - 1 and tags[j] == f"I-{held[2]}":
            held = (held[0], j, kind)
        else:
            if held:
                yield held
            held = (j, j, kind)
    if held:
        yield held


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by the first one's kind in brackets."""
    out, at = [], 0
    i = 0
    while i < len(spans):
        kind, a, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[at:a], f"[{kind.removeprefix('crf_').upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, crf: CRF | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans, an array of (kind, start, end) in code points, by start and then kind; the whole text is read.

    Kinds email, ip, card and phone are known forms; crf_* is what the random field adds. A null or empty text has
    no spans; rows with equal or null ids each get a row; an empty table gives an empty result; other columns are
    not read.
    """
    arrow_limits(docs.sparkSession)
    finder = Finder(crf or fit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), span_array(finder.find_batch(texts(b)))], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def mask_personal_data(docs: DataFrame, crf: CRF | None = None, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, with personal data in text_col masked; null texts stay null."""
    arrow_limits(docs.sparkSession)
    finder = Finder(crf or fit())
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_batches(batches):
            ts = b.column(at).to_pylist()
            found = finder.find_batch(["" if t is None else t for t in ts])
            masked = pa.array([t if t is None or not f else mask(t, f) for t, f in zip(ts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([masked if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)
