"""Approximate nearest neighbours by shifted Hilbert curves.

Unit vectors are projected onto several random subspaces; in each, a Hilbert curve through a randomly shifted grid
orders them. Every ordering is cut into ranges of equal size; a query is compared with all vectors in its own range
and the neighbouring ones, in double precision, and the results of all orderings merge.

The window is a share of the table, not a fixed number of rows: vectors without low-dimensional structure need that to
keep the recall at any size, at a cost that grows as queries times rows. Work is cut into units of bounded rows and
queries, and within a unit into blocks: a single-precision product leaves out what is surely farther, the rest is
measured in double precision. Equal vectors are searched for, and found, as one: of copies only as many of the smallest
ids enter the index as a result can hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, discard, materialize

#: Orderings; projected dimensions and bits each (64 bits of key); ranges of an ordering; ranges on either side that are searched.
ORDERINGS, DIMENSIONS, BITS, RANGES, REACH = 12, 8, 8, 40, 2
#: Least rows of a range (a small table has fewer ranges); rows and queries of one unit of work, and of a block of it.
RANGE_ROWS, UNIT_ROWS, UNIT_QUERIES, BLOCK_ROWS, BLOCK_QUERIES = 200, 16_384, 2_048, 8_192, 256


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each grid cell (rows of integers below 2**bits) along the Hilbert curve.

    From the highest bit down, each coordinate's bit tells whether to mirror the lower bits of the first coordinate or
    to swap them with those of that coordinate; a Gray decoding across coordinates ends the transform.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            set_ = (x[i] >> b & 1).astype(bool)
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << np.uint64(1) | (x[i] >> b & 1).astype(np.uint64)
    return key


class Orderings:
    """Random projections, shifts and the scale of the data."""

    def __init__(self, mean: np.ndarray, covariance: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        dim = len(mean)
        self.p = min(DIMENSIONS, dim)
        self.mean = mean
        self.bases = [np.linalg.qr(rng.normal(size=(dim, self.p)))[0] for _ in range(ORDERINGS)]
        self.scales = [np.sqrt(np.maximum(np.diag(b.T @ covariance @ b), 1e-12)) for b in self.bases]
        self.shifts = [rng.uniform(0, 0.5, self.p) for _ in range(ORDERINGS)]

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Rows of signed keys, one for each ordering; coordinates go through a normal curve to even out the grid."""
        out = []
        for base, scale, shift in zip(self.bases, self.scales, self.shifts, strict=True):
            z = (unit - self.mean) @ base / scale
            even = 0.5 * (1 + np.tanh(math.sqrt(2 / math.pi) * (z + 0.044715 * z**3)))
            cells = np.minimum(((0.5 * even + shift) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            out.append((hilbert_keys(cells, BITS) ^ np.uint64(1 << 63)).view(np.int64))
        return np.stack(out, 1)


def _matrix(column, kind: str) -> np.ndarray:
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1).astype(float) if cells else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x with q, the same for equal vectors wherever they stand."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """id and vec (bytes) of the vectors that take part, and the bytes' kind: null, empty, zero and non-finite vectors, and null ids, take none."""
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [None if v is None or None in v else np.array(v, kind) for v in b.column(1).to_pylist()]
            good = [r is not None and bool(np.isfinite(r).all()) and bool(r.any()) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good, pa.bool_())), pa.array([r.tobytes() for r, g in zip(rows, good, strict=True) if g], pa.binary())], ["id", "vec"])

    id_kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, f"id {id_kind}, vec binary"), kind


def closest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of q, ids and exact cosines of its keep nearest rows of x, ties to smaller ids; in blocks."""
    best: list[tuple[np.ndarray, np.ndarray]] = [(ids[:0], np.zeros(0))] * len(q)
    slack = 4 * np.finfo(np.float32).eps * max(q.shape[1], 16)  # of a single-precision product of unit vectors
    asked = _unit(q).astype(np.float32)
    for at in range(0, len(x), BLOCK_ROWS):
        rows, own = x[at : at + BLOCK_ROWS], ids[at : at + BLOCK_ROWS]
        unit = _unit(rows).astype(np.float32).T
        k = min(keep, len(own))
        for i in range(0, len(q), BLOCK_QUERIES):
            rough = asked[i : i + BLOCK_QUERIES] @ unit
            least = np.partition(rough, len(own) - k, axis=1)[:, len(own) - k] - 2 * slack
            for j, row in enumerate(rough, i):
                near = np.flatnonzero(row >= least[j - i])
                found = np.concatenate([best[j][0], own[near]]), np.concatenate([best[j][1], cosines(rows[near], q[j])])
                order = np.lexsort((found[0], -found[1]))[:keep]
                best[j] = found[0][order], found[1][order]
    yield from best


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by every, its k nearest found by cosine.

    Nearest first, ties to the smaller id; all other vectors are candidates, and if there are fewer than k, all are
    returned. See usable() for vectors that take no part; vectors of one length are compared with each other; repeated
    ids with equal vectors count once; an empty table gives an empty result; other columns are not read. Recall against
    brute force is measured in the tests.
    """
    spark = vectors.sparkSession
    arrow_limits(spark)
    rows, kind = usable(vectors, id_col, vector_col)
    id_kind = rows.schema["id"].dataType.simpleString()
    rows = materialize(rows.distinct(), "ann-vectors")
    out = None
    for length in sorted(r[0] for r in rows.select(F.octet_length("vec")).distinct().collect()):  # one, as a rule
        own = _nearest(rows.where(F.octet_length("vec") == length), kind, k, every)
        out = own if out is None else out.unionByName(own)
    discard(rows)
    return spark.createDataFrame([], f"query_id {id_kind}, rank int, vec_id {id_kind}, score double") if out is None else out


def _nearest(rows: DataFrame, kind: str, k: int, every: int) -> DataFrame:
    """nearest() of distinct rows (id, vec) of one length."""
    spark = rows.sparkSession
    id_kind = rows.schema["id"].dataType.simpleString()
    copies = rows.withColumn("copy", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("copy") <= k + 1).drop("copy")
    copies = materialize(copies, "ann-index")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, c = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = _unit(_matrix(b.column(0), kind))
                n, s, c = n + len(x), s + x.sum(0), c + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tobytes()]), pa.array([c.tobytes()])], ["n", "s", "c"])

    def add(parts: pa.Table) -> pa.Table:
        s, c = (sum(np.frombuffer(x) for x in parts.column(name).to_pylist()) for name in ("s", "c"))
        return pa.table({"n": [sum(parts.column("n").to_pylist())], "s": [s.tobytes()], "c": [c.tobytes()]})

    # each partition sums its own part, 64 groups sum the parts, the driver at most 64 rows of fixed size
    parts = copies.select("vec").mapInArrow(sums, "n long, s binary, c binary").withColumn("g", F.pmod(F.xxhash64("s"), F.lit(64)))
    moments = parts.groupBy("g").applyInArrow(add, "n long, s binary, c binary").collect()
    n = sum(m.n for m in moments)
    mean = sum(np.frombuffer(m.s) for m in moments) / n
    covariance = sum(np.frombuffer(m.c) for m in moments).reshape(len(mean), -1) / n - np.outer(mean, mean)
    orders = Orderings(mean, covariance)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = orders.keys(_unit(_matrix(b.column(1), kind))) if b.num_rows else np.zeros((0, ORDERINGS), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(keys), pa.list_(pa.int64()))], ["id", "vec", "keys"])

    with_keys = f"id {id_kind}, vec binary, keys array<long>"
    index = materialize(copies.mapInArrow(keyed, with_keys), "ann-keys")
    queries = rows.where(F.pmod(F.col("id"), F.lit(every)) == 0)
    distinct_queries = queries.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec").mapInArrow(keyed, with_keys)
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        row = index.agg(*(F.percentile_approx(F.col("keys")[o], F.array(*map(F.lit, shares)), F.lit(10_000)).alias(f"o{o}") for o in range(ORDERINGS))).first()
        cuts = [np.array(row[f"o{o}"], np.int64) for o in range(ORDERINGS)]
    else:
        cuts = [np.zeros(0, np.int64)] * ORDERINGS
    used = ORDERINGS if ranges > 2 * REACH + 1 else 1  # one ordering already covers everything
    queries_here = queries.count() * min(2 * REACH + 1, ranges) / ranges
    pieces, turns = max(1, math.ceil(n / ranges / UNIT_ROWS)), max(1, math.ceil(queries_here / UNIT_QUERIES))

    def dealt(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.array(b.column(2).to_pylist(), np.int64).reshape(b.num_rows, ORDERINGS)
            take, order, at = [], [], []
            for o in range(used):
                own = np.searchsorted(cuts[o], keys[:, o], side="right")
                low = np.clip(own - REACH, 0, max(0, ranges - 2 * REACH - 1)) if window else own
                for j in range(min(2 * REACH + 1, ranges) if window else 1):
                    take.append(np.arange(b.num_rows))
                    order.append(np.full(b.num_rows, o))
                    at.append(low + j)
            take = np.concatenate(take)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(order), pa.int32()), pa.array(np.concatenate(at), pa.int32()), b.column(0).take(pa.array(take)), b.column(1).take(pa.array(take))], ["o", "at", "id", "vec"])

    placed = f"o int, at int, id {id_kind}, vec binary"
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>"))
    stored = index.mapInArrow(lambda b: dealt(b, 0), placed).withColumn("piece", F.pmod(F.xxhash64("id"), F.lit(pieces))).withColumn("turn", all_of(turns))
    asked = distinct_queries.mapInArrow(lambda b: dealt(b, 1), placed).withColumn("piece", all_of(pieces)).withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(turns)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            asking = left.column("id").to_pylist()
            found = closest(_matrix(left.column("vec"), kind), _matrix(right.column("vec"), kind), np.array(right.column("id").to_pylist()), k + 1)
            for q, (ids, scores) in zip(asking, found, strict=True):
                out[0].extend([q] * len(ids))
                out[1].extend(ids.tolist())
                out[2].extend(scores.tolist())
        at = left.schema.field("id").type
        return pa.table({"q": pa.array(out[0], at), "vec_id": pa.array(out[1], at), "score": pa.array(out[2], pa.float64())})

    unit = ("o", "at", "piece", "turn")
    found = asked.groupBy(*unit).cogroup(stored.groupBy(*unit)).applyInArrow(search, f"q {id_kind}, vec_id {id_kind}, score double")
    found = found.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    named = queries.select(F.col("id").alias("query_id"), "vec").join(queries.groupBy("vec").agg(F.min("id").alias("q")), "vec").drop("vec")
    result = named.join(found, "q").where(F.col("query_id") != F.col("vec_id"))
    ranked = result.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    out = materialize(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ann-found")
    for table in (copies, index):
        discard(table)
    return out
