"""Near-duplicates by HyperMinHash.

A document's shingle hashes are dealt to buckets; a bucket's register holds the leading-zero count of its smallest
value and the mantissa bits after them (16 bits in all). Bands of registers are the keys under which documents meet.
Pairs are estimated from their registers, corrected for chance collisions, and confirmed on the full shingle sets.

Nothing expands a group into all its pairs: documents with one set are one class; in each band bucket, members are
first compared with the bucket's smallest id alone; of buckets that then still hold more than one component, only
pairs between different components are looked at: by their registers in small buckets, and among all members of large
ones those that an exact prefix filter leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, by_batches, discard, materialize, texts, word_windows
from .graph import components

#: 32 bands of 5 registers: a pair at similarity 0.85 is missed with probability 1e-8, at 0.8 with 3e-6.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Members of a bucket up to which all its pairs are estimated; rows of a prefix group that are compared in one go.
BLOCK, HOT_BLOCK = 64, 2048
#: Groups (a key and a few numbers each) that are broadcast.
BROADCAST_GROUPS = 100_000
#: Most hash buckets for the frequencies of shingles, as a power of two: 8 MB that go to all tasks.
FREQUENCIES = 21
#: An empty bucket takes the register of the first filled bucket in its own fixed order of all buckets.
_ORDERS = np.stack([np.random.default_rng(4000 + j).permutation(REGISTERS) for j in range(REGISTERS)])


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; the whole sequence is one if there are fewer words; empty without words."""
    return np.unique(word_windows(text, k)[0])


def set_id(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a non-empty sorted set: leading zeros in the high 6 bits, mantissa in the low 10.

    The bucket is the high part of hash * REGISTERS, the value the low part; both grow with the hash, so the smallest
    value of a bucket is the first of its run in the sorted set.
    """
    m = np.uint64(REGISTERS)
    half = np.uint64(32)
    with np.errstate(over="ignore"):
        bucket = ((shingles >> half) * m + (((shingles & np.uint64(0xFFFFFFFF)) * m) >> half)) >> half
        value = shingles * m
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    low = value[first] | np.uint64(1)
    zeros = 63 - np.frexp(low.astype(np.float64))[1] + 1
    zeros = np.clip(zeros, 0, 63)
    exact = (low << zeros.astype(np.uint64)) >> np.uint64(63) == 0  # rounding up to the next power of two
    zeros = np.where(exact & (zeros < 63), zeros + 1, zeros)
    with np.errstate(over="ignore"):
        mantissa = ((low << zeros.astype(np.uint64)) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out = np.zeros(REGISTERS, np.uint16)
    own = bucket[first].astype(np.int64)
    out[own] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    if len(own) < REGISTERS:
        filled = np.zeros(REGISTERS, bool)
        filled[own] = True
        empty = np.flatnonzero(~filled)
        order = _ORDERS[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(1)]]
    return out


def estimate(same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, without the share that is equal by chance.

    Two minima under n_a and n_b values fall into one cell of relative width 2**-MANTISSA with probability
    ln 2 * 2**-MANTISSA * n_a * n_b / (n_a + n_b)**2.
    """
    chance = math.log(2) * 2.0**-MANTISSA * n_a * n_b / np.square(n_a + n_b, dtype=float)
    return (same - chance) / (1 - chance)


def worth_checking(same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes allow the similarity, and the estimate lies within five standard errors of it."""
    j = percent / 100
    error = np.sqrt(j * (1 - j) / np.minimum(REGISTERS, np.maximum(1, np.minimum(n_a, n_b))))
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (estimate(same, n_a, n_b) >= j - 5 * error)


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (size of the shingle set), sid (digest of the set) and regs; sid and regs are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_batches(batches):
            n, sid, regs = [], [], []
            for t in texts(b):
                s = shingle_set(t, k)
                n.append(len(s))
                sid.append(set_id(s) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.binary()), pa.array(regs, pa.binary())], ["id", "n", "sid", "regs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, sid binary, regs binary")


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate allows the similarity, with their sets' digests."""
    kind = pairs.schema["a"].dataType.simpleString()
    side = lambda x: reps.select(*(F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "regs", "sid")))
    wide = pairs.join(side("a"), F.col("a") == F.col("rep_a")).join(side("b"), F.col("b") == F.col("rep_b"))
    wide = wide.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
            na, nb = (b.column(c).to_numpy() for c in ("n_a", "n_b"))
            keep = pa.array(worth_checking((ra == rb).mean(1), na, nb, percent))
            yield b.select(["a", "b", "sid_a", "sid_b"]).filter(keep)

    return wide.select("a", "b", "n_a", "n_b", "sid_a", "sid_b", "regs_a", "regs_b").mapInArrow(run, f"a {kind}, b {kind}, sid_a binary, sid_b binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity. docs: id, text."""
    kind = pairs.schema["a"].dataType.simpleString()
    of = lambda x: docs.select(F.col("id").alias(f"id_{x}"), F.col("text").alias(f"text_{x}"))
    wide = pairs.join(of("b"), F.col("b") == F.col("id_b")).drop("id_b").join(of("a"), F.col("a") == F.col("id_a")).drop("id_a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))
        for b in by_batches(batches):
            keep = []
            for ta, tb, sa, sb in zip(*(b.column(c).to_pylist() for c in ("text_a", "text_b", "sid_a", "sid_b")), strict=True):
                if ta != last[0]:
                    last = (ta, shingle_set(ta, k))
                x, y = last[1], shingle_set(tb, k)
                common = len(np.intersect1d(x, y, assume_unique=True))
                # an id may stand for several rows: only those with the sketched sets count
                keep.append(100 * common >= percent * (len(x) + len(y) - common) and set_id(x) == sa and set_id(y) == sb)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return wide.select("a", "b", "sid_a", "sid_b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def _units(rows: DataFrame, keys: list[str], size: int, pairs, kind: str) -> DataFrame:
    """Pairs (a, b), a < b, found by pairs(left, right, same) within each group of rows by keys; rows: keys, size, rep, ...

    A group of more than size rows is cut into blocks by a hash of rep; each two blocks are a unit of work of their own.
    """
    blocks = rows.withColumn("blocks", F.ceil(F.col("size") / size).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    once = blocks.where("blocks = 1").withColumns({"i": F.lit(0), "j": F.lit(0)}).drop("blocks", "size")
    many = blocks.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "size", "other")
    by, n = [*keys, "i", "j"], len(keys) + 2
    units = once.unionByName(many).select(*by, "own", *[c for c in rows.columns if c not in (*keys, "size")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[tuple]) -> pa.RecordBatch:
            i, j = held[0][n - 2 : n]
            left, right = ([r[n + 1 :] for r in held if r[n] == x] for x in (i, j))
            found = pairs(left, right, i == j) if left and right else []
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], at), pa.array([max(p) for p in found], at)], ["a", "b"])

        held: list[tuple] = []
        for b in batches:
            at = b.schema.field("rep").type
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[:n] != held[0][:n]:
                    if len(held) > 1:
                        yield emit(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield emit(held)

    return units.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _candidates(left: list[tuple], right: list[tuple], same: bool, test) -> list[tuple]:
    """Pairs of ids of different components that pass test(x, others); rows: rep, comp, then what the test takes."""
    rep, comp = (np.array([r[c] for r in right]) for c in (0, 1))
    columns = [np.array([r[c] for r in right], dtype=object if isinstance(right[0][c], bytes) else None) for c in range(2, len(right[0]))]
    out = []
    for x in left:
        y = np.flatnonzero((comp != x[1]) & ((rep > x[0]) if same else (rep != x[0])))
        if len(y):
            out += [(x[0], r) for r in rep[y[test(x[2:], [c[y] for c in columns])]].tolist()]
    return out


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within small buckets whose registers allow the similarity, unless both are hot.

    members: key, size, rep, comp, n, regs, hot.
    """

    def test(x: tuple, y: list[np.ndarray]) -> np.ndarray:
        regs = np.frombuffer(b"".join(y[1]), np.uint16).reshape(-1, REGISTERS)
        allowed = worth_checking((regs == np.frombuffer(x[1], np.uint16)).mean(1), y[0], np.full(len(y[0]), x[0]), percent)
        return allowed & ~(y[2] & x[2])

    return _units(members, ["key"], BLOCK, lambda a, b, same: _candidates(a, b, same, test), members.schema["rep"].dataType.simpleString())


def _member_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, np.ndarray]]]]:
    """Batches of rows with sid and text, and the places and sets of those rows whose text has that set."""
    for b in by_batches(batches):
        yield b, [(i, s) for i, (t, sid) in enumerate(zip(texts(b), b.column("sid").to_pylist(), strict=True)) if set_id(s := shingle_set(t, k)) == sid]


def _frequencies(wide: DataFrame, k: int, size: int) -> np.ndarray:
    """How many shingles of all members fall into each of size hash buckets. wide: sid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for _, sets in _member_sets(batches, k):
            for _, s in sets:
                np.add.at(counts, s % np.uint64(size), 1)
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], ["bucket", "n"])

    found = wide.select("sid", "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.uint32)
    out[found.column("bucket").to_numpy()] = np.minimum(found.column("n").to_numpy(), 2**32 - 1)
    return out


def _heads(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """rep, comp, n, shingle, place: the first n - ceil(percent / 100 * n) + 1 shingles of each member (rep, comp, n, sid), from rare to frequent.

    The frequency is that of a shingle's hash bucket, of which there are about as many as shingles, up to FREQUENCIES;
    shingles of one frequency are ordered by value. All members share the order, which is all that the prefix filter asks for.
    """
    kind = members.schema["rep"].dataType.simpleString()
    wide = materialize(members.join(docs, F.col("rep") == F.col("id")).select("rep", "comp", "n", "sid", "text"), "hot")
    total = wide.agg(F.sum("n")).first()[0] or 0
    size = 1 << min(max(total.bit_length(), 10), FREQUENCIES)
    frequencies = _frequencies(wide, k, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _member_sets(batches, k):
            heads = [s[np.lexsort((s, frequencies[s % np.uint64(size)]))[: len(s) - -(-len(s) * percent // 100) + 1]] for _, s in sets]
            lengths = [len(h) for h in heads]
            at = pa.array(np.repeat([i for i, _ in sets], lengths).astype(np.int64))
            values = np.concatenate([np.zeros(0, np.uint64), *heads]).view(np.int64)
            places = np.concatenate([np.zeros(0, np.int64), *map(np.arange, lengths)])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("rep", "comp", "n")), pa.array(values), pa.array(places)], ["rep", "comp", "n", "shingle", "place"])

    out = materialize(wide.mapInArrow(run, f"rep {kind}, comp {kind}, n long, shingle long, place long"), "heads")
    discard(wide)
    return out


def _with_groups(rows: DataFrame, key: str, *aggregates: F.Column, where: str = "true") -> DataFrame:
    """rows, of groups by key that fulfil where, with the group's size and its other aggregates.

    Groups are counted with partial sums, so a heavy one is no heavy task. Up to BROADCAST_GROUPS of them go to all
    tasks; more are joined by key, and Spark splits the partition of a heavy one.
    """
    groups = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"), *aggregates).where(where), "groups")
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, key)


def _across_hot(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of different components among the members of large buckets that can reach the similarity.

    members: rep, comp, n, sid. An exact prefix join: with shingles ordered from rare to frequent among the members,
    two sets that reach the similarity t share one of the first n - ceil(t * n) + 1 shingles of each, and what comes
    after it is enough for the overlap that the sizes ask for. The rarest shingles are the edits by which a copy
    differs, so copies that have nothing but a common original in common do not meet.
    """
    heads = _heads(members, docs, k, percent)
    mixed = _with_groups(heads, "shingle", F.min("comp").alias("low"), F.max("comp").alias("high"), where="low <> high")

    def test(x: tuple, y: list[np.ndarray]) -> np.ndarray:
        most = 1 + np.minimum(x[0] - x[1] - 1, y[0] - y[1] - 1)
        return (100 + percent) * most >= percent * (x[0] + y[0])

    return _units(mixed.select("shingle", "size", "rep", "comp", "n", "place"), ["shingle"], HOT_BLOCK, lambda a, b, same: _candidates(a, b, same, test), members.schema["rep"].dataType.simpleString())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, kept: one row for each row of docs.

    Words are runs of other than ASCII white space, A-Z lower-cased; a set has the distinct k-word shingles. Two
    documents are linked if 100 * intersection >= percent * union. component_id is the smallest id reachable (the
    document's own included), kept whether it is the document's own. A null or empty text has an empty set and no
    links; a null id stays alone (component_id null, kept true); rows that share an id are one document: they
    link what any of their texts links, and each row has the size of its own set; an empty table gives an empty result; other columns are not read.
    """
    arrow_limits(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = materialize(sketches(base, k, "id", "text"), "sketches")
    with_set = sketched.where(F.col("sid").isNotNull() & F.col("id").isNotNull())
    reps = materialize(with_set.groupBy("sid").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")), "classes")
    width = 2 * ROWS
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * width + 1, F.lit(width))))
    keys = reps.select("rep", F.explode(band).alias("key"))
    met = materialize(_with_groups(keys, "key", F.min("rep").alias("pivot"), where="size > 1"), "members")
    stars = materialize(met.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = materialize(_confirmed(_estimated(stars, reps, percent), base, k, percent).distinct(), "links")
    labels = components(links)

    # Buckets of three or more that still hold several components: pairs between these.
    large = met.where("size > 2").join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    large = materialize(large, "large")
    discard(met)
    mixed = _with_groups(large, "key", F.min("comp").alias("low"), F.max("comp").alias("high"), where="low <> high").drop("low", "high")
    rest = materialize(mixed.join(reps.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).drop("r"), "mixed")
    discard(large)
    hot = rest.where(F.col("size") > BLOCK).select("rep", "comp", "n", "sid").distinct()
    marked = rest.where(F.col("size") <= BLOCK).join(hot.select(F.col("rep").alias("h")), F.col("rep") == F.col("h"), "left").withColumn("hot", F.col("h").isNotNull())
    few = _across(marked.select("key", "size", "rep", "comp", "n", "regs", "hot"), percent)
    many = _across_hot(hot, base, k, percent)
    across = materialize(few.unionByName(many).distinct().join(stars, ["a", "b"], "left_anti"), "across")
    more = materialize(_confirmed(_estimated(across, reps, percent), base, k, percent).distinct(), "links")
    if not more.isEmpty():
        discard(labels)
        labels = components(links.unionByName(more))
    for table in (stars, links, rest, across, more):
        discard(table)

    of_set = reps.select("sid", "rep").join(labels, F.col("rep") == F.col("node"), "left").select(F.col("sid").alias("s"), F.coalesce("comp", "rep").alias("comp"))
    out = sketched.drop("regs").join(of_set, F.col("sid") == F.col("s"), "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("comp", "id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
    out = materialize(out, "near-duplicates")
    for table in (sketched, reps, labels):
        discard(table)
    return out


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which near_duplicates() keeps the id, with all their columns; of rows with one id, one.

    Rows with a null id stay, as do null and empty texts; an empty table gives an empty result.
    """
    judged = near_duplicates(docs, k, percent, id_col, text_col)
    gone = judged.where(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct()
    out = docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
    ids = judged.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1")
    if ids.isEmpty():
        return out
    return out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(out.where(F.col(id_col).isNull()))
