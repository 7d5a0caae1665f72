"""Benchmark decontamination: rare n-gram seeds join training passages to test items, local alignment scores them.

Seeds are three words of the test items, in a row or with one left out between them (so that a copy of which every
third word is another one still has some), of each item and form the rarest ones by document frequency in the whole corpus, so
that phrases everybody uses start no alignment, while a passage that leaked into very many documents keeps its seeds.
Seeds, items and documents are tables. A bitmap of fixed size tells which of a document's grams may be known; those are
joined to the seeds. Around each shared seed a stretch of the document is aligned with the item by Smith-Waterman over
words; the score is divided by that of the item with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, by_batches, discard, materialize, mix64, texts, word_windows

#: Words of a seed; share of an item's n-grams of a form, rarest first, that serve as seeds; and at least so many; up to so many words all do.
SEED_WORDS, SEED_SHARE, SEED_LEAST, SEED_SHORT = 3, 0.75, 6, 24
#: Forms of seeds: the places of their words.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's own score from which a document counts as contaminated.
THRESHOLD = 0.5
#: Bits of the map of known grams (2 MB, whatever the benchmark's size), and of the table that is looked at before it.
FILTER_BITS, NEAR_BITS = 24, 20
#: Rows up to which a table of seeds, and words up to which a table of items, is broadcast; salts of the join beyond.
BROADCAST_SEEDS, BROADCAST_WORDS, BROADCAST_TEXTS, SALTS = 1_000_000, 4_000_000, 300_000, 16
_PUNCTUATION = b".,;:!?\"'()[]"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word: A-Z lower-cased, without punctuation marks."""
    return word_windows(text.encode().translate(None, _PUNCTUATION), 1)[0]


def grams(words: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A hash of the words at these places from each word on."""
    n = len(words) - shape[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(sum(1 << p for p in shape)))
        for i, p in enumerate(shape):
            h = h * _ODD[0] + words[p : n + p] * _ODD[1 + i % 2]
    return mix64(h)


def shapes_of(n: int) -> list[tuple[int, ...]]:
    """The forms of an item of n words; one shorter than a seed is a seed as a whole."""
    return [s for s in SHAPES if s[-1] < n] if n >= SEED_WORDS else [tuple(range(n))] if n else []


def align(items: list[np.ndarray], stretches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each item with its stretch, and the stretch's word at which it ends; padded batches.

    Along a row, gaps are closed by a running maximum: the best over all gap lengths is max(T[j'] + j') - j.
    """
    k, n, m = len(items), max(map(len, items)), max(map(len, stretches))
    a, b = np.zeros((k, n), np.uint64), np.zeros((k, m), np.uint64)
    in_a, in_b = np.zeros((k, n), bool), np.zeros((k, m), bool)
    for i, (x, y) in enumerate(zip(items, stretches, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
        in_a[i, : len(x)], in_b[i, : len(y)] = True, True
    steps = np.arange(m + 1, dtype=np.int32) * -GAP
    row, best, end = np.zeros((k, m + 1), np.int32), np.zeros(k, np.int32), np.zeros(k, np.int64)
    for i in range(n):
        same = (a[:, i, None] == b) & in_b & in_a[:, i, None]
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(same, MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + steps, axis=1) - steps
        at = row.argmax(1)
        top = row[np.arange(k), at]
        better = (top > best) & in_a[:, i]
        best, end = np.where(better, top, best), np.where(better, at - 1, end)
    return best, end


def grams_of(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The number of each form (that of a whole short item is its number of words, negative) and its grams."""
    for shape in shapes_of(len(words)):
        yield (SHAPES.index(shape) if shape in SHAPES else -len(words)), grams(words, shape)


def _items(benchmark: DataFrame) -> DataFrame:
    """item (a number), item_id, n, words (bytes) and grams (form, gram, place) of the distinct items that have words."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        for b in by_batches(batches):
            rows, at = [], []
            for i, t in enumerate(texts(b)):
                words = word_hashes(t)
                if len(words):
                    found = [{"form": f, "gram": h, "place": p} for f, g in grams_of(words) for p, h in enumerate(g.view(np.int64).tolist())]
                    rows.append((part << 32 | count, len(words), words.tobytes(), found))
                    at.append(i)
                    count += 1
            cells = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.struct([("form", pa.int32()), ("gram", pa.int64()), ("place", pa.int32())]))))]
            yield pa.RecordBatch.from_arrays([cells[0], b.column(0).take(pa.array(at, pa.int64())), *cells[1:]], ["item", "item_id", "n", "words", "grams"])

    known = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    return known.mapInArrow(run, f"item long, item_id {kind}, n int, words binary, grams array<struct<form:int,gram:long,place:int>>")


class Filter:
    """A bitmap of grams that may be known: none that is known is missed."""

    def __init__(self, grams_table: DataFrame, forms: list[int]):
        place = F.col("gram").bitwiseAND((1 << FILTER_BITS) - 1)
        size = 4096 * 8
        maps = grams_table.select(F.floor(place / size).alias("at"), F.expr(f"bitmap_bit_position((gram & {(1 << FILTER_BITS) - 1}) % {size} + 1)").alias("bit")).groupBy("at").agg(F.expr("bitmap_construct_agg(bit)").alias("map")).collect()
        bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)  # of fixed size
        for m in maps:
            bits[m["at"] * 4096 : (m["at"] + 1) * 4096] = np.frombuffer(m["map"], np.uint8)
        self.bits = bits
        #: Whether any gram with these low bits is known: a table that stays in a core's cache, looked at first.
        self.near = np.unpackbits(bits, bitorder="little").reshape(-1, 1 << NEAR_BITS).any(0)
        self.shapes = [SHAPES[f] if f >= 0 else tuple(range(-f)) for f in forms]

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grams of a document that may be known, and the words at which they start."""
        found, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for shape in self.shapes:
            g = grams(words, shape)
            p = np.flatnonzero(self.near[(g & np.uint64((1 << NEAR_BITS) - 1)).view(np.int64)])
            low = (g[p] & np.uint64((1 << FILTER_BITS) - 1)).view(np.int64)
            p = p[(self.bits[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)]
            found.append(g[p])
            at.append(p)
        return np.concatenate(found), np.concatenate(at)


def _frequencies(rows: DataFrame, known: Filter) -> DataFrame:
    """gram, docs: document counts of the grams of rows (id, text) that may be known, added up by batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_batches(batches):
            own = [np.unique(known.hits(word_hashes(t))[0]) for t in texts(b)]
            gram, docs = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(docs.astype(np.int64))], ["gram", "docs"])

    return rows.select("text").mapInArrow(run, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))


def _seeds(items: DataFrame, frequencies: DataFrame) -> DataFrame:
    """gram, item, n, place: the rarest grams of each item and form (of equal ones, by hash and place)."""
    every = items.select("item", "n", F.explode("grams").alias("g")).select("item", "n", "g.form", "g.gram", "g.place")
    own = Window.partitionBy("item", "form")
    ranked = every.join(frequencies, "gram", "left").withColumns({"r": F.row_number().over(own.orderBy(F.coalesce("docs", F.lit(0)), "gram", "place")), "of": F.count(F.lit(1)).over(own)})
    keep = F.when(F.col("n") > SEED_SHORT, F.greatest(F.lit(SEED_LEAST), F.ceil(SEED_SHARE * F.col("of")))).otherwise(F.col("of"))
    return ranked.where(F.col("r") <= keep).select("gram", "item", "n", "place")


def _candidates(rows: DataFrame, known: Filter) -> DataFrame:
    """key (a number), id, text and hits (gram, at) of the rows with a gram that may be a seed."""
    kind = rows.schema["id"].dataType.simpleString()
    struct = pa.struct([("gram", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        for b in by_batches(batches):
            keys, take, hits = [], [], []
            for i, t in enumerate(texts(b)):
                found, at = known.hits(word_hashes(t))
                if len(found):
                    keys.append(part << 32 | count)
                    take.append(i)
                    hits.append(pa.StructArray.from_arrays([pa.array(found.view(np.int64)), pa.array(at.astype(np.int32))], ["gram", "at"]))
                    count += 1
            ends = np.cumsum([0, *map(len, hits)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays([pa.array([], struct), *hits]))
            own = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *own.columns, lists], ["key", "id", "text", "hits"])

    return rows.mapInArrow(run, f"key long, id {kind}, text string, hits array<struct<gram:long,at:int>>")


def _joined(large: DataFrame, small: DataFrame, on: str, salt: str, broadcast: bool) -> DataFrame:
    """large with the rows of small: small goes to all tasks if it may, else it is repeated for each salt of the large side's rows."""
    if broadcast:
        return large.join(F.broadcast(small), on)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return large.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salted, [on, "_salt"]).drop("_salt")


def stretches(diagonals: list[int], item: int, document: int) -> Iterator[tuple[int, int]]:
    """Parts of a document of so many words around places where an item of so many words may start; those that touch are one."""
    slack, held = max(3, item // 2), None
    for d in sorted(diagonals):
        lo, hi = max(0, d - slack), min(document, d + item + slack)
        if held and lo <= held[1]:
            held = (held[0], hi)
        else:
            if held:
                yield held
            held = (lo, hi)
    if held:
        yield held


def _stretches(candidates: DataFrame, seeds: DataFrame, broadcast: bool) -> DataFrame:
    """key, id, item, start, words: the stretches of each document to be aligned with each item that shares a seed."""
    kind = candidates.schema["id"].dataType.simpleString()
    hits = _joined(candidates.select("key", F.explode("hits").alias("h")).select("key", "h.gram", "h.at"), seeds, "gram", "key", broadcast)
    # of one document and item: at most as many diagonals as the document has words
    pairs = hits.groupBy("key", "item", "n").agg(F.collect_set(F.col("at") - F.col("place")).alias("diagonals"))
    of_key = pairs.groupBy("key").agg(F.collect_list(F.struct("item", "n", "diagonals")).alias("pairs"))  # at most the items
    wide = candidates.select("key", "id", "text").join(of_key, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_batches(batches):
            rows, at = [], []
            for i, (key, text, pairs) in enumerate(zip(*(b.column(c).to_pylist() for c in ("key", "text", "pairs")), strict=True)):
                words = word_hashes(text)
                for p in pairs:
                    for lo, hi in stretches(p["diagonals"], p["n"], len(words)):
                        rows.append((key, p["item"], lo, words[lo:hi].tobytes()))
                        at.append(i)
            cells = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([cells[0], b.column("id").take(pa.array(at, pa.int64())), *cells[1:]], ["key", "id", "item", "start", "stretch"])

    return wide.mapInArrow(run, f"key long, id {kind}, item long, start long, stretch binary")


def _aligned(pairs: DataFrame, threshold: float) -> DataFrame:
    """key, id, item, item_id, score, end_word of the stretches that reach the threshold; pairs has stretch and words."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_batches(batches):
            items, own, start = ([np.frombuffer(x, np.uint64) for x in b.column(c).to_pylist()] if c != "start" else b.column(c).to_pylist() for c in ("words", "stretch", "start"))
            order = sorted(range(b.num_rows), key=lambda i: len(own[i]))
            score, end, i = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64), 0
            while i < len(order):
                # the stretches of a batch are of like length
                j = i + 1
                while j < len(order) and (j - i) * len(own[order[j]]) < 400_000:
                    j += 1
                part = order[i:j]
                i = j
                best, at = align([items[x] for x in part], [own[x] for x in part])
                for x, s, e in zip(part, best.tolist(), at.tolist(), strict=True):
                    score[x], end[x] = s / (MATCH * len(items[x])), start[x] + e
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "id", "item", "item_id")), pa.array(score), pa.array(end)], ["key", "id", "item", "item_id", "score", "end_word"])
            yield out.filter(pa.array(score >= threshold))

    columns = ("key", "id", "item", "item_id")
    return pairs.select(*columns, "start", "stretch", "words").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", score double, end_word long")


def _matches(rows: DataFrame, benchmark: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The rows of rows (id, text) that may match (key, text), and key, id, item, item_id, score, end_word of the matches."""
    arrow_limits(rows.sparkSession)
    items = materialize(_items(benchmark), "items")
    every = items.select(F.explode("grams").alias("g")).select("g.gram", "g.form")
    forms = sorted(r.form for r in every.select("form").distinct().collect())  # at most one a form
    frequencies = materialize(_frequencies(rows, Filter(every, forms)), "frequencies")
    seeds = materialize(_seeds(items, frequencies), "seeds")
    candidates = materialize(_candidates(rows, Filter(seeds, forms)), "candidates")
    pairs = _stretches(candidates, seeds, seeds.count() <= BROADCAST_SEEDS)
    words = items.agg(F.sum("n")).first()[0] or 0
    wide = _joined(pairs, items.select("item", "item_id", "words"), "item", "key", words <= BROADCAST_WORDS)
    found = _aligned(wide, threshold).groupBy("key", "item").agg(F.max(F.struct("score", (-F.col("end_word")).alias("minus_end"), "id", "item_id")).alias("m"))
    found = materialize(found.select("key", "m.id", "m.item_id", "m.score", (-F.col("m.minus_end")).alias("end_word")), "matches")
    for table in (items, frequencies, seeds):
        discard(table)
    return candidates, found


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, item_id, score, end_word: the pairs of a document and a test item whose alignment reaches the threshold.

    score is the best local alignment's score as a share of the item's own; end_word is the number of the document's
    word at which it ends (of equal scores, the first). Ids of documents and items may be of any type. A null or empty
    text, a null item id, and an item without words match nothing; rows of docs with equal or null ids are looked at
    one by one; repeated items count once for each text; empty tables give an empty result; other columns are not read.
    """
    candidates, found = _matches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, threshold)
    discard(candidates)
    return found.select(F.col("id").alias(id_col), "item_id", "score", "end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that match no test item, with all their columns.

    A row goes if its text matches, whatever its id; rows with a null or empty text stay, in an empty table as well as
    beside an empty benchmark all do. Texts that match are known by their SHA-256; up to BROADCAST_TEXTS of them go to
    all tasks, more are joined by shuffle.
    """
    candidates, found = _matches(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), benchmark, threshold)
    digest = lambda c: F.unhex(F.sha2(c, 256))
    bad = materialize(candidates.join(found.select("key").distinct(), "key", "left_semi").select(digest(F.col("text")).alias("_digest")).distinct(), "contaminated")
    discard(candidates)
    discard(found)
    if bad.count() <= BROADCAST_TEXTS:
        bad = F.broadcast(bad)
    return docs.join(bad, digest(docs[text_col]) == bad["_digest"], "left_anti")
