"""Shared pieces of the text operators: tables, durable intermediate tables, Arrow batching, caches."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_C = ctypes.CDLL(None)

#: What counts as white space between words in the word-based operators.
ASCII_SPACE = "\x20\x09-\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Small Arrow batches, so that very long texts do not pile up in one Python worker.

    Plans read these settings when they run, after this returns, so they stay; what the caller set lower stays too.
    """
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        own = spark.conf.get(key)
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where driver and executors are one process (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"on {master}, spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "ticklake-scratch")
    return at.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ticklake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table that materialize() wrote, once nothing reads it any more."""
    if path := getattr(df, "_ticklake_path", None):
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def release_memory() -> None:
    """Gives freed memory back to the system, as idle Python workers would keep it (where the C library has the call)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_C, "malloc_trim", None):
        trim(0)


def id_bucket(col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def texts(batch: pa.RecordBatch, column: str | int = "text") -> list[str]:
    """The column as Python strings; null counts as empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def span_array(rows: list[list[tuple[str, int, int]]]) -> pa.ListArray:
    """Lists of (kind, start, end) as an Arrow column."""
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = [s for r in rows for s in r]
    fields = [pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.int32()), pa.array([s[2] for s in flat], pa.int32())]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["kind", "start", "end"]))


def joined(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the parts of a text that spans cover."""
    starts, ends = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


SPANS = "array<struct<kind:string,start:int,end:int>>"


def spans_text(col):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


class TwoGenerationCache:
    """A dict bounded to two generations of so many bytes: frequent keys stay, rare ones go; lookups are plain dict reads."""

    #: What an entry takes in the dict, beside its key and value.
    ENTRY = 100

    def __init__(self, size: int):
        self.size, self.held, self.young, self.old = size, 0, {}, {}

    def missing(self, keys) -> list:
        """Distinct keys without a value; values of the old generation move to the young one."""
        if self.held > self.size:
            self.old, self.young, self.held = self.young, {}, 0
        young, old, out, moved = self.young, self.old, [], []
        for k in set(keys).difference(young):
            v = old.get(k)
            if v is None:
                out.append(k)
            else:
                young[k] = v
                moved.append(k)
        self._count(moved)
        return out

    def add(self, keys: list, values: list) -> None:
        self.young.update(zip(keys, values, strict=True))
        self._count(keys)

    def _count(self, keys: list) -> None:
        young = self.young
        self.held += self.ENTRY * len(keys) + sum(map(getsizeof, keys)) + sum(getsizeof(young[k]) for k in keys)


#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n, kept for texts of usual length."""
    if _POWERS["n"] < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE, np.uint64)]))
            down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _INV, np.uint64)]))
        if size > 1 << 24:
            return up, down
        _POWERS.update(n=size, up=up, down=down)
    return _POWERS["up"], _POWERS["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xCA5A826395121157)
        return h ^ (h >> np.uint64(32))


#: Bytes of text that are hashed at once; a longer word stands for itself by a digest.
HASHED = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def _windows(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of all windows of k words, at least one of which there is."""
    joined = b" ".join(words)
    data = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], gaps + 1])[: len(words) - k + 1]
    ends = np.concatenate([gaps, [len(data)]])[k - 1 :]
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_windows(text: str | bytes, k: int, whole_if_short: bool = True) -> tuple[np.ndarray, int]:
    """64-bit hashes of all k-word windows (A-Z lower-cased, words joined by one space) and the number of words.

    With fewer than k words, the whole sequence is one window (or there is none, if not whole_if_short). Long texts
    are taken in parts, each with the last k - 1 words before it.
    """
    data = text.encode() if isinstance(text, str) else text
    out, words, n, at = [], [], 0, 0
    while at < len(data):
        stop = len(data)
        if stop - at > HASHED:
            gap = _GAP.search(data, at + HASHED)
            stop = gap.end() if gap else stop
        new = data[at:stop].lower().split()
        if stop - at > HASHED:
            new = [w if len(w) <= HASHED else xxhash.xxh3_128_hexdigest(w).encode() + b"\0" for w in new]
        at = stop
        n += len(new)
        words = words + new
        if len(words) >= k:
            out.append(_windows(words, k))
            words = words[len(words) - k + 1 :]
    if n and n < k and whole_if_short:
        out.append(_windows(words, n))
    return (out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.uint64), *out])), n


def pack(a: np.ndarray, ascending: bool = False) -> bytes:
    """An array of integers in few bytes: differences if it ascends, byte planes (high bytes of small numbers are zero), compressed."""
    a = np.ascontiguousarray(a)
    if ascending and len(a):
        a = np.concatenate([a[:1], np.diff(a)])
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind: type, ascending: bool = False) -> np.ndarray:
    """What pack() was given."""
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    a = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(a, dtype=kind) if ascending else a


def by_batches(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows, in slices of about size bytes."""
    for b in batches:
        step = max(1, int(b.num_rows * size / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
