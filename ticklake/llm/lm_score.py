"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of word pairs and single words with a uniform share; the mixture weights
depend on how often the context was seen. They are learned by expectation-maximisation on held-out counts: each
training token in turn is deleted from the counts that predict it. All counts cover the whole training part.

Tokens travel in blocks of numpy arrays: each block of documents sends its distinct words and pairs to the hash range
they belong to, once, with its own counts; ranges add up and answer each block with the totals. A frequent word is one
entry per block, so no key is heavy. A block has a row for a range only if it has entries there, so there are never more
rows than entries. The last two passes (learning weights, scoring) read blocks with their totals and need no further
shuffle. What a worker holds is bounded by a block, a range, or a slice of tokens.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, by_batches, discard, id_bucket, materialize, mix64, pack, release_memory, unpack, word_windows

#: UTF-8 bytes of text in a block, tokens for each hash range, and tokens that are looked at together.
BLOCK_BYTES, RANGE_TOKENS, SLICE = 16 << 20, 1_000_000, 1 << 18
#: Context-frequency buckets: 0, then powers of two.
BUCKETS = 34
#: Steps per doubling in which probabilities are held for learning weights.
STEPS = 2
_START, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def _blocks(docs: DataFrame) -> DataFrame:
    """docs (id, held, text) as blocks: ids, held, lens (words of each), vocab (hashes, frequent first), tokens (places in vocab); packed."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        ids, held, words, size, at = [], [], [], 0, None

        def emit() -> pa.RecordBatch:
            flat = np.concatenate([np.zeros(0, np.uint64), *words])
            vocab, tokens, counts = np.unique(flat, return_inverse=True, return_counts=True)
            frequent = np.argsort(-counts, kind="stable")  # small numbers for frequent words: fewer bytes
            place = np.empty(len(vocab), np.int32)
            place[frequent] = np.arange(len(vocab), dtype=np.int32)
            lens = np.array([len(w) for w in words], np.int32)
            cells = [pa.array([part << 32 | count]), pa.array([ids], pa.list_(at)), pa.array([held], pa.list_(pa.bool_())), pa.array([pack(lens)]), pa.array([pack(vocab[frequent])]), pa.array([pack(place[tokens])]), pa.array([len(flat)])]
            return pa.RecordBatch.from_arrays(cells, ["block", "ids", "held", "lens", "vocab", "tokens", "n"])

        for b in by_batches(batches):
            at = b.schema.field("id").type
            for i, h, t in zip(*(b.column(c).to_pylist() for c in ("id", "held", "text")), strict=True):
                data = (t or "").encode()
                ids.append(i)
                held.append(h)
                words.append(word_windows(data, 1)[0])
                size += len(data) + 64
                if size >= BLOCK_BYTES:
                    yield emit()
                    count += 1
                    ids, held, words, size = [], [], [], 0
        if ids:
            yield emit()
        release_memory()

    return docs.mapInArrow(run, f"block long, ids array<{kind}>, held array<boolean>, lens binary, vocab binary, tokens binary, n long")


class Block:
    """A block's tokens with one end for each document: cur and prev are places in vocab, then the end and the start.

    Without vocab, size tells how many words it had.
    """

    def __init__(self, held: list[bool], lens: bytes, vocab: bytes, tokens: bytes, size: int = 0):
        self.lens = unpack(lens, np.int32).astype(np.int64)
        self.vocab, words = unpack(vocab, np.uint64) if vocab else None, unpack(tokens, np.int32)
        v, total = size if self.vocab is None else len(self.vocab), int(self.lens.sum()) + len(self.lens)
        self.stops = np.cumsum(self.lens + 1)
        self.starts = self.stops - self.lens - 1
        last = np.zeros(total, bool)
        last[self.stops - 1] = True
        self.cur = np.empty(total, np.int32)
        self.cur[~last], self.cur[last] = words, v
        self.prev = np.empty(total, np.int32)
        self.prev[1:] = self.cur[:-1]
        self.prev[self.starts] = v + 1
        self.train = np.repeat(~np.array(held, bool), self.lens + 1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of word pairs, and each token's place among them."""
        h = np.concatenate([self.vocab, [_END, _START]])
        with np.errstate(over="ignore"):
            keys = (h * np.uint64(0x9E3779B97F4A7C15))[self.prev]
            keys += h[self.cur]
            keys = mix64(keys)
        known, at = np.unique(keys, return_inverse=True)
        return known, at.astype(np.int32)


def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal hash ranges starts among sorted keys."""
    edges = np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _counted(blocks: DataFrame, ranges: int) -> DataFrame:
    """For each block and each hash range that it has entries in, its sorted distinct words and pairs there with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                x = Block(row["held"], row["lens"], row["vocab"], row["tokens"])
                by_hash = np.argsort(x.vocab)
                vocab, words = x.vocab[by_hash], np.bincount(x.cur[x.train], minlength=len(x.vocab) + 2)[: len(x.vocab)][by_hash]
                keys, at = x.pairs()
                pairs = np.bincount(at[x.train], minlength=len(keys))
                del x, at, by_hash
                w, p = _ranges(vocab, ranges), _ranges(keys, ranges)
                some = np.flatnonzero((np.diff(w) > 0) | (np.diff(p) > 0)).tolist()
                for at in range(0, len(some), 256):
                    part = some[at : at + 256]
                    cells = [[pack(v[s[r] : s[r + 1]], up) for r in part] for v, s, up in ((vocab, w, True), (words, w, False), (keys, p, True), (pairs, p, False))]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([row["block"]] * len(part), pa.int64()), *(pa.array(c, pa.binary()) for c in cells)], ["range", "block", "words", "word_n", "pairs", "pair_n"])
        release_memory()

    return blocks.select("block", "held", "lens", "vocab", "tokens").mapInArrow(run, "range int, block long, words binary, word_n binary, pairs binary, pair_n binary")


def _totals(table: pa.Table) -> pa.Table:
    """One range: each block's entries answered with totals; the number of training words goes with the first block."""
    out, distinct = [], 0
    for keys, counts in (("words", "word_n"), ("pairs", "pair_n")):
        parts = [unpack(x, np.uint64, True) for x in table.column(keys).to_pylist()]
        sizes = [len(p) for p in parts]
        own = np.concatenate([unpack(x, np.int64) for x in table.column(counts).to_pylist()])
        flat = np.concatenate(parts)
        del parts
        known, at = np.unique(flat, return_inverse=True)
        del flat
        total = np.bincount(at, own, len(known)).astype(np.int64)
        if keys == "words":
            distinct = int((total > 0).sum())
        ends = np.cumsum([0, *sizes])
        out.append([pack(total[at[a:b]]) for a, b in zip(ends, ends[1:])])
        del known, at, own, total
    release_memory()
    return pa.table({"range": table.column("range"), "block": table.column("block"), "word_n": pa.array(out[0], pa.binary()), "pair_n": pa.array(out[1], pa.binary()), "distinct": pa.array([distinct] + [0] * (table.num_rows - 1), pa.int64())})


def _answered(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with the totals of their words (by place in vocab) and of their pairs (by token)."""

    def read(table: pa.Table, what: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64)] + [unpack(x, np.int64) for x in table.column(f"{what}_n").to_pylist()])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("range")
        row = left.to_pylist()[0]
        x = Block(row["held"], row["lens"], row["vocab"], row["tokens"])
        words = np.empty(len(x.vocab), np.int64)
        words[np.argsort(x.vocab)] = read(right, "word")
        pairs = read(right, "pair")[x.pairs()[1]]
        del x
        release_memory()
        return pa.table({"ids": left.column("ids"), "held": left.column("held"), "lens": left.column("lens"), "tokens": left.column("tokens"), "word_n": pa.array([pack(words)], pa.binary()), "pair_n": pa.array([pack(pairs)], pa.binary()), "distinct": pa.array([sum(right.column("distinct").to_pylist())], pa.int64())})

    kind = blocks.schema["ids"].dataType.simpleString()
    schema = f"ids {kind}, held array<boolean>, lens binary, tokens binary, word_n binary, pair_n binary, distinct long"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def _read(batch: pa.RecordBatch, train_docs: int) -> Iterator[tuple[Block, list, Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]]]:
    """Blocks, their ids and, for slices of their tokens, the totals of the word, of its context and of the pair."""
    for i in range(batch.num_rows):
        row = batch.slice(i, 1).to_pylist()[0]
        words, pairs = unpack(row["word_n"], np.int64), unpack(row["pair_n"], np.int64)
        x = Block(row["held"], row["lens"], b"", row["tokens"], len(words))
        known = np.concatenate([words, [train_docs, train_docs]])
        slices = (slice(j, j + SLICE) for j in range(0, len(pairs), SLICE))
        yield x, row, ((s, known[x.cur[s]], known[x.prev[s]], pairs[s]) for s in slices)


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(count > 0, np.frexp(count.astype(float))[1], 0), BUCKETS - 1)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def learn_weights(cells: list[tuple[int, int, int, int]], uniform: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights (uniform, word, pair) of each bucket by expectation-maximisation.

    cells: bucket, steps of -log2 of the pair's and of the word's deleted estimate (-1: zero), and the tokens there.
    """
    out = np.tile([0.2, 0.6, 0.2], (BUCKETS, 1))
    out[0] = [0.5, 0.5, 0.0]
    if not cells:
        return out
    c = np.array(cells, dtype=float)
    p = np.stack([np.full(len(c), uniform), *(np.where(c[:, i] >= 0, 2.0 ** (-(c[:, i] + 0.5) / STEPS), 0) for i in (2, 1))], 1)
    for k in range(BUCKETS):
        own = c[:, 0] == k
        if own.any():
            w, q, n = np.full(3, 1 / 3), p[own], c[own, 3]
            for _ in range(rounds):
                share = q * w
                share /= share.sum(1, keepdims=True)
                w = (share * n[:, None]).sum(0) / n.sum()
            w = np.maximum(w, [1e-6, 0, 0])
            out[k] = w / w.sum()
    return out


def lm_scores(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Tokens are words (runs of other than ASCII white space, A-Z lower-cased) and one end. Counts come from documents
    whose crc32(id as text) mod folds is not 0; the others, and null ids, are held out. base_score is the add-0.1
    unigram score, score the log10 probability under the mixture. A null or empty text is its end alone; rows with
    equal ids each count and get a row; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(id_bucket(id_col, folds) == 0, F.lit(True)).alias("held"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = materialize(_blocks(rows), "lm-blocks")
    tokens = blocks.agg(F.sum("n")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(tokens / RANGE_TOKENS))
    answers = _counted(blocks, ranges).groupBy("range").applyInArrow(_totals, "range int, block long, word_n binary, pair_n binary, distinct long")
    full = materialize(_answered(blocks, answers), "lm-totals")
    discard(blocks)

    sizes = full.select("distinct", F.explode(F.arrays_zip("held")).alias("x")).agg(F.sum((~F.col("x.held")).cast("long"))).first()[0] or 0
    train_docs = sizes
    distinct = (full.agg(F.sum("distinct")).first()[0] or 0) + (train_docs > 0)

    def train_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for held, lens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n += int((unpack(lens, np.int32)[~np.array(held, bool)].astype(np.int64) + 1).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    total = full.select("held", "lens").mapInArrow(train_tokens, "n long").agg(F.sum("n")).first()[0] or 0
    uniform = 1 / (distinct + 1)

    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()  # at most as many cells as there are in all
        for b in batches:
            for x, _, slices in _read(b, train_docs):
                for s, word, context, pair in slices:
                    t = x.train[s]
                    word, context, pair = word[t] - 1, context[t] - 1, pair[t] - 1
                    steps = [np.where(n > 0, np.floor(-np.log2(np.maximum(_ratio(n, d), 1e-300)) * STEPS), -1).astype(np.int64) for n, d in ((pair, context), (word, np.full(len(word), total - 1)))]
                    cell, n = np.unique((context_bucket(context) << 20) | (steps[0] + 1 << 10) | (steps[1] + 1), return_counts=True)
                    sums.update(dict(zip(cell.tolist(), n.tolist(), strict=True)))
        cell = np.array(list(sums), np.int64)
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array(cell >> 20), pa.array((cell >> 10 & 1023) - 1), pa.array((cell & 1023) - 1), pa.array(list(sums.values()), pa.int64())], ["bucket", "pair", "word", "n"])

    # at most BUCKETS * (64 * STEPS)**2 cells, however large the corpus
    cells = full.mapInArrow(deleted, "bucket long, pair long, word long, n long").groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights(sorted(tuple(c) for c in cells), uniform)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.field("ids").type.value_type
            for x, row, slices in _read(b, train_docs):
                base, mixed, known = np.empty(len(x.cur)), np.empty(len(x.cur)), np.empty(len(x.cur), bool)
                for s, word, context, pair in slices:
                    w = weights[context_bucket(context)]
                    mixed[s] = np.log10(w[:, 0] * uniform + w[:, 1] * _ratio(word, np.full(len(word), total)) + w[:, 2] * _ratio(pair, context))
                    base[s] = np.log10((word + 0.1) / (total + 0.1 * (distinct + 1)))
                    known[s] = word > 0
                sums = [np.add.reduceat(v, x.starts) for v in (base, mixed, known.view(np.int8).astype(np.int64))] if len(x.starts) else [np.zeros(0)] * 3
                n = len(x.starts)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], at), pa.array(row["held"], pa.bool_()), pa.array(x.lens + 1), pa.array(sums[2].astype(np.int64)), pa.array(np.full(n, total)), pa.array(sums[0]), pa.array(sums[1])], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        release_memory()

    out = full.mapInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
