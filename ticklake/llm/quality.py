"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of each whole text are standardised and mapped to sqrt(2/D)*cos(Wx+b), whose inner products approximate a
Gaussian kernel. Each partition of the labelled rows sums its part of the normal equations; the ridge scores of a
held-back part of the labelled rows are calibrated by pooling adjacent violators.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, by_batches, discard, id_bucket, materialize, texts

STATISTICS = ("log_chars", "log_words", "mean_word", "long_words", "upper", "digits", "symbols", "pipes", "stops", "non_ascii", "spaces", "lines", "distinct_words", "distinct_lines", "distinct_pairs", "top_word", "shouted", "marked", "byte_entropy", "squeezed", "capital_words", "bare_words", "short_words")
_UPPER, _DIGIT = slice(65, 91), slice(48, 58)
_SYMBOLS = np.frombuffer(b"#$%&*@^~<>=+_\\/{}[]!", np.uint8)


def statistics(text: str) -> list[float]:
    """The statistics of one text; of an empty one, zeros."""
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, w = len(data), len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    sizes = np.fromiter(map(len, words), np.int64, w)
    share = counts[counts > 0] / n
    lines = [x for x in data.split(b"\n") if x]
    tally: dict[bytes, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    pairs = len(set(zip(words, words[1:]))) / max(w - 1, 1)
    return [
        math.log1p(n), math.log1p(w), float(sizes.mean()), float((sizes > 12).mean()), counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n, counts[_SYMBOLS].sum() / n, counts[124] / n, counts[46] / w, counts[128:].sum() / n, (counts[32] + counts[9]) / n,
        math.log1p(w / max(len(lines), 1)), len(tally) / w, len(set(lines)) / max(len(lines), 1), pairs, max(tally.values()) / w,
        sum(x.isupper() for x in words) / w, sum(x[-1] in b"#$%&*|!" for x in words) / w, float(-(share * np.log2(share)).sum()), len(zlib.compress(data, 1)) / n, sum(65 <= x[0] <= 90 for x in words) / w, sum(x.isalpha() for x in words) / w, float((sizes <= 3).mean()),
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _design(x, self.mean, self.scale, self.weights, self.phase) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def _design(x, mean, scale, weights, phase) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([np.ones((len(z), 1)), math.sqrt(2 / len(phase)) * np.cos(z @ weights + phase)], axis=1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit of y on x by pooling adjacent violators: knots and levels for interpolation."""
    at, own = np.unique(x, return_inverse=True)  # equal x are one point
    sums, weights = np.bincount(own, y, len(at)), np.bincount(own, minlength=len(at))
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    for v, s, w in zip(at.tolist(), sums.tolist(), weights.tolist(), strict=True):
        blocks.append([s, float(w), v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], last]
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    levels = np.array([v for b in blocks for v in [(b[0] + 0.5) / (b[1] + 1)] * 2])
    return knots, np.maximum.accumulate(levels)


def labelled_statistics(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, seed: int) -> DataFrame:
    """_stats, _y and _late of at most about max_rows labelled documents; docs has _id and _text.

    Labels are chosen by a hash of their id and sent to all tasks (max_rows of an id, a number and a mark), so that
    statistics are computed of chosen rows only. A repeated label counts once, with its largest value; an id that
    several rows share counts once, with the smallest of their statistics; null ids and labels are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_known")).agg(F.max(label).cast("double").alias("_y"))
    total = known.count()
    part = F.pmod(F.xxhash64(F.lit(seed), "_known"), F.lit(1_000_000))
    late = F.pmod(F.xxhash64(F.lit(seed + 1), "_known"), F.lit(10)) == 0
    chosen = known.where(part < F.lit(math.ceil(1e6 * min(1.0, max_rows / max(total, 1))))).withColumn("_late", late)
    rows = docs.join(F.broadcast(chosen), F.col("_id") == F.col("_known")).select("_known", "_y", "_late", "_text")
    kind = labels.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_batches(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([statistics(t) for t in texts(b, "_text")], pa.list_(pa.float64()))], ["_known", "_y", "_late", "_stats"])

    found = rows.mapInArrow(run, f"_known {kind}, _y double, _late boolean, _stats array<double>")
    return found.groupBy("_known", "_y", "_late").agg(F.min("_stats").alias("_stats")).select("_stats", "_y", "_late")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 60_000, features: int = 256, gamma: float = 0.02, ridge: float = 1e-4, seed: int = 11) -> Model | None:
    """The model of label 1 against 0, from at most about max_rows labelled rows (a documented bound).

    docs has _id and _text, labels has doc_id and the label; see labelled_statistics() for what is learned from. A
    tenth of the labelled rows, by hash, serves the calibration alone; if there is none, as in tables of a few labelled
    rows, all rows serve both. None if there are no labelled rows.
    """
    table = materialize(labelled_statistics(docs, labels, label, max_rows, seed), "quality-train")
    rows = table.coalesce(8)  # of the small table alone: what writes it is not held back
    n = len(STATISTICS)
    moments = rows.select([F.avg(F.col("_stats")[i]).alias(f"m{i}") for i in range(n)] + [F.stddev_pop(F.col("_stats")[i]).alias(f"s{i}") for i in range(n)] + [F.count("*").alias("n")]).first()
    if not moments["n"]:
        return None
    mean, scale = np.array([moments[f"m{i}"] for i in range(n)]), np.array([moments[f"s{i}"] for i in range(n)])
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    weights, phase = rng.normal(0, math.sqrt(2 * gamma), (n, features)), rng.uniform(0, 2 * math.pi, features)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, r = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for b in batches:
            if b.num_rows:
                z = _design(np.array(b.column(0).to_pylist()), mean, scale, weights, phase)
                g += z.T @ z
                r += z.T @ b.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()]), pa.array([r.tobytes()])], ["g", "r"])

    early = rows.where(~F.col("_late")).select("_stats", "_y")
    parts = early.mapInArrow(sums, "g binary, r binary").collect()  # one row of fixed size for each of 8 partitions
    g = sum(np.frombuffer(p.g) for p in parts).reshape(features + 1, -1)
    beta = np.linalg.solve(g + ridge * max(g[0, 0], 1) * np.diag([1e-9] + [1.0] * features), sum(np.frombuffer(p.r) for p in parts))
    late = rows.where("_late").select("_stats", "_y").collect() or rows.select("_stats", "_y").collect()  # about a tenth of max_rows, or a few dozen rows
    late.sort(key=lambda x: (x._stats, x._y))
    discard(table)
    model = Model(mean, scale, weights, phase, beta, np.zeros(1), np.zeros(1))
    raw = model.raw(np.array([x._stats for x in late]))
    return Model(mean, scale, weights, phase, beta, *isotonic(raw, np.array([x._y for x in late])))


def _scored(batch_texts: list[str], model: Model | None) -> np.ndarray:
    """Scores of texts, 0.5 each without a model."""
    if model is None or not batch_texts:
        return np.full(len(batch_texts), 0.5)
    return model.score(np.array([statistics(t) for t in batch_texts]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **fit_options) -> DataFrame:
    """id_col, held_out, score, predicted (1 if score >= threshold, else 0) for every document.

    Learns from labelled rows whose crc32(id as text) mod 5 is not 0; the others, and null ids, are held out. Only the
    text enters a score. A null text counts as empty and gets the score of zero statistics; without labelled rows every
    score is 0.5; rows with equal or null ids each get a row; an empty table gives an empty result; other columns are
    not read.
    """
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    model = fit(rows, labels.where(id_bucket("doc_id", 5) != 0), **fit_options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scored(texts(b, "_text"), model))], ["_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"_id {kind}, score double")
    return out.select(F.col("_id").alias(id_col), F.coalesce(id_bucket("_id", 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **fit_options) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns.

    Each row is judged by its own text, also where ids are null or repeated; a null text counts as empty, and stays
    null if its row is accepted. Without labelled rows every score is 0.5; an empty table gives an empty result.
    """
    arrow_limits(docs.sparkSession)
    model = fit(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), labels.where(id_bucket("doc_id", 5) != 0), **fit_options)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_batches(batches):
            yield b.filter(pa.array(_scored(texts(b, at), model) >= threshold))

    return docs.mapInArrow(run, docs.schema)
