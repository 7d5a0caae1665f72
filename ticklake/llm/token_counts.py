"""Token counts: batch encoding in an Arrow function that returns lengths only.

Texts are cut at safe boundaries, so that neither very long texts nor repeated ones cost more than their distinct
segments: with a piece vocabulary in which no piece holds the word mark after another letter, a single space between
two other letters is such a boundary; the space goes, as the library puts the mark before each segment itself.
Segments not seen lately are encoded in batches balanced by bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerationCache, arrow_limits, by_batches, release_memory, texts

MARK = "▁"
#: Bytes of segments and their counts that stay known in one process (twice, while the older half is on its way out).
CACHE_BYTES = 32 << 20
_CUT = re.compile(r"(?<=[^ ]) (?=[^ ])")


def balanced(segments: list[str], size: int) -> Iterator[list[str]]:
    """Batches of about size bytes in UTF-8, and a few for each segment; a longer segment is a batch of its own."""
    batch, held = [], 0
    for s in segments:
        own = 8 + (len(s) if s.isascii() else len(s.encode()))
        if batch and held + own > size:
            yield batch
            batch, held = [], 0
        batch.append(s)
        held += own
    if batch:
        yield batch


class PieceCounter:
    """Lengths as the sentencepiece library gives them, without begin and end tokens."""

    def __init__(self, path: str, batch_bytes: int = 256 << 10):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.safe = not any(MARK in p.lstrip(MARK) for p in pieces) and self.sp.encode("a b") == self.sp.encode("a") + self.sp.encode("b")
        self.batch_bytes, self.cache = batch_bytes, TwoGenerationCache(CACHE_BYTES)

    def forget(self) -> None:
        """Empties the cache, so that an idle worker holds little more than the model."""
        self.cache = TwoGenerationCache(CACHE_BYTES)
        release_memory()

    def segments(self, text: str) -> list[str]:
        if MARK in text:
            text = text.replace(MARK, " ")
        if not self.safe:
            return [text] if text else []
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return _CUT.split(text)
        return text.split(" ") if text else []

    def count(self, batch: list[str]) -> list[int]:
        cut = [self.segments(t) for t in batch]
        for part in balanced(self.cache.missing([s for c in cut for s in c]), self.batch_bytes):
            self.cache.add(part, [len(ids) for ids in self.sp.encode(part, num_threads=1)])
        get = self.cache.young.__getitem__
        return [sum(map(get, c)) for c in cut]


class JsonCounter:
    """Lengths as the tokenizers library gives them for a tokenizer file in JSON; texts are encoded whole."""

    def __init__(self, path: str, batch_bytes: int = 256 << 10):
        from tokenizers import Tokenizer

        self.tokenizer, self.batch_bytes = Tokenizer.from_file(path), batch_bytes
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def forget(self) -> None:
        release_memory()

    def count(self, batch: list[str]) -> list[int]:
        return [len(e.ids) for part in balanced(batch, self.batch_bytes) for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]


_LOADED: dict[str, PieceCounter | JsonCounter] = {}


def load(path: str) -> PieceCounter | JsonCounter:
    """The counter, once per Python process."""
    if path not in _LOADED:
        _LOADED[path] = (JsonCounter if path.endswith(".json") else PieceCounter)(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text.

    A null text counts as empty (0, 0, false); rows with equal or null ids each get a row; an empty table gives an
    empty result; other columns are not read.
    """
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(tokenizer)
        for b in by_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counter.count(texts(b, "text")), pa.int64())], ["id", "n_bytes", "n_tokens"])
        counter.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
