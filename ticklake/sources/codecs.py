"""Binary recordings: quote files with their update-id companions, depth files with their checkpoints.

Files are read through Spark's binaryFile source, so any store that Spark knows will do, and decoded in Arrow batches,
one task a file. Decoders take bytes and raise ValueError on anything malformed; they never read past the end.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The layouts of the file formats.
QUOTE_HEADER, QUOTE_MAGIC = struct.Struct("<8sIIIIQQQQQ"), b"QENGINE1"
QUOTE_RECORD = np.dtype([("ts_ns", "<u8"), ("best_bid", "<f8"), ("best_ask", "<f8"), ("bid_volume", "<u4"), ("ask_volume", "<u4")])
IDS_HEADER, IDS_MAGIC = struct.Struct("<8sIIIIQ"), b"QUPDID1\0"
DEPTH_HEADER, DEPTH_MAGIC = struct.Struct("<8sIIIIQQQ16s8Q"), b"QL2EVT1\0"
EVENT_HEADER, LEVEL = struct.Struct("<IIQQQQIIqQIIQ"), np.dtype([("price", "<i8"), ("qty", "<u8")])
CHECK_HEADER, CHECK_MAGIC = struct.Struct("<8sIIIIQ"), b"QL2CHK1\0"
CHECK_RECORD = np.dtype([("event_index", "<u8"), ("update_id", "<u8"), ("state_hash", "<u8")])
VOLUME_SCALE, UNIT, MOST_LEVELS = 1_000_000, 100_000_000, 20_000
KINDS = {1: "snapshot", 2: "depth", 3: "trade", 4: "boundary"}
REASONS = {1: "connection_start", 2: "sequence_gap", 3: "snapshot_retry", 4: "user_stop", 5: "queue_overflow", 6: "connection_end"}


def _need(good: bool, what: str) -> None:
    if not good:
        raise ValueError(what)


def _body(data: bytes, header: struct.Struct, record: int, what: str) -> tuple:
    _need(len(data) >= header.size, f"{what}: shorter than its header")
    _need((len(data) - header.size) % record == 0, f"{what}: ends with part of a record")
    return header.unpack_from(data)


def decode_quotes(data: bytes) -> tuple[int, np.ndarray]:
    """Creation time and records of a quote file."""
    magic, version, size, record, flags, scale, created, *zeros = _body(data, QUOTE_HEADER, QUOTE_RECORD.itemsize, "quote file")
    _need(magic == QUOTE_MAGIC and version == 1 and size == QUOTE_HEADER.size and record == QUOTE_RECORD.itemsize and not flags, "quote file: unknown format")
    _need(scale == VOLUME_SCALE and created > 0 and not any(zeros), "quote file: bad header values")
    return created, np.frombuffer(data, QUOTE_RECORD, offset=size)


def decode_ids(data: bytes, created: int) -> np.ndarray:
    """Update ids of the quote file with that creation time: positive and strictly increasing."""
    magic, version, size, record, flags, own = _body(data, IDS_HEADER, 8, "id file")
    _need(magic == IDS_MAGIC and version == 1 and size == IDS_HEADER.size and record == 8 and not flags, "id file: unknown format")
    _need(own == created, "id file: belongs to another quote file")
    ids = np.frombuffer(data, "<u8", offset=size)
    _need(bool((ids > 0).all() and (ids[1:] > ids[:-1]).all()), "id file: ids do not increase")
    return ids


def encode_quotes(created: int, rows: np.ndarray) -> bytes:
    return QUOTE_HEADER.pack(QUOTE_MAGIC, 1, QUOTE_HEADER.size, QUOTE_RECORD.itemsize, 0, VOLUME_SCALE, created, 0, 0, 0) + np.ascontiguousarray(rows, QUOTE_RECORD).tobytes()


def encode_ids(created: int, ids: np.ndarray) -> bytes:
    return IDS_HEADER.pack(IDS_MAGIC, 1, IDS_HEADER.size, 8, 0, created) + np.ascontiguousarray(ids, "<u8").tobytes()


def encode_event(kind: str, ts_ns: int, event_ms: int = 0, first_id: int = 0, final_id: int = 0, bids: list = (), asks: list = (), trade_price: int = 0, trade_qty: int = 0, flags: int = 0) -> bytes:
    """One depth-file event with its check sum."""
    _need(ts_ns > 0, "event: no receipt time")
    _need(max(len(bids), len(asks)) <= MOST_LEVELS, "event: too many levels")
    payload = np.array([tuple(x) for x in (*bids, *asks)], LEVEL).tobytes()
    code = {v: k for k, v in KINDS.items()}[kind]
    return EVENT_HEADER.pack(code, flags, ts_ns, event_ms, first_id, final_id, len(bids), len(asks), trade_price, trade_qty, zlib.crc32(payload), EVENT_HEADER.size + len(payload), 0) + payload


def encode_depth(created: int, symbol: str, events: list[bytes]) -> bytes:
    _need(symbol.isalnum() and symbol.isascii() and symbol.upper() == symbol and 0 < len(symbol) < 16, "depth file: bad symbol")
    return DEPTH_HEADER.pack(DEPTH_MAGIC, 1, DEPTH_HEADER.size, EVENT_HEADER.size, LEVEL.itemsize, UNIT, UNIT, created, symbol.encode(), *[0] * 8) + b"".join(events)


def decode_depth(data: bytes, strict: bool = False) -> Iterator[dict]:
    """Events of a depth file in order; strict also wants levels, of positive quantity, in snapshots."""
    _need(len(data) >= DEPTH_HEADER.size, "depth file: shorter than its header")
    magic, version, size, event_size, level_size, price_unit, qty_unit, created, symbol, *zeros = DEPTH_HEADER.unpack_from(data)
    _need(magic == DEPTH_MAGIC and version == 1 and (size, event_size, level_size) == (DEPTH_HEADER.size, EVENT_HEADER.size, LEVEL.itemsize), "depth file: unknown format")
    _need(price_unit == qty_unit == UNIT and created > 0 and not any(zeros), "depth file: bad header values")
    name = symbol.rstrip(b"\0").decode("ascii", "replace")
    at, index = size, 0
    while at < len(data):
        _need(at + event_size <= len(data), "depth file: ends within an event header")
        code, flags, ts, ms, first, final, n_bids, n_asks, price, qty, crc, record, zero = EVENT_HEADER.unpack_from(data, at)
        _need(code in KINDS and not zero and ts > 0, "event: bad header values")
        _need(max(n_bids, n_asks) <= MOST_LEVELS and record == event_size + (n_bids + n_asks) * level_size, "event: its size disagrees with its levels")
        payload = data[at + event_size : at + record]
        _need(len(payload) == record - event_size, "depth file: ends within an event")
        _need(zlib.crc32(payload) == crc, "event: check sum does not match")
        kind, empty = KINDS[code], not n_bids and not n_asks
        levels = [(int(p), int(q)) for p, q in np.frombuffer(payload, LEVEL)]
        _need(all(p > 0 for p, _ in levels), "event: a price is not positive")
        good = {
            "snapshot": not flags and first == final > 0 and not ms and not price and not qty and (not strict or n_bids > 0 and n_asks > 0 and all(q for _, q in levels)),
            "depth": not flags and not price and not qty and 0 < first <= final,
            "trade": flags in (0, 1) and empty and not final and first > 0 and price > 0 and qty > 0,
            "boundary": flags in REASONS and empty and not (ms or first or final or price or qty),
        }[kind]
        _need(good, f"event: invalid {kind}")
        yield {"symbol": name, "event_ix": index, "kind": kind, "ts_ns": ts, "event_ms": ms, "first_id": first, "final_id": final, "bids": levels[:n_bids], "asks": levels[n_bids:], "trade_price": price, "trade_qty": qty, "flags": flags}
        at += record
        index += 1


def decode_checkpoints(data: bytes, created: int) -> np.ndarray:
    """Checkpoints of the depth file with that creation time: positive, at strictly increasing events."""
    magic, version, size, record, flags, own = _body(data, CHECK_HEADER, CHECK_RECORD.itemsize, "checkpoint file")
    _need(magic == CHECK_MAGIC and version == 1 and size == CHECK_HEADER.size and record == CHECK_RECORD.itemsize and not flags and own == created, "checkpoint file: unknown format or other recording")
    rows = np.frombuffer(data, CHECK_RECORD, offset=size)
    ix = rows["event_index"]
    _need(bool(all((rows[c] > 0).all() for c in CHECK_RECORD.names) and (ix[1:] > ix[:-1]).all()), "checkpoint file: bad records")
    return rows


def encode_checkpoints(created: int, rows: list[tuple[int, int, int]]) -> bytes:
    return CHECK_HEADER.pack(CHECK_MAGIC, 1, CHECK_HEADER.size, CHECK_RECORD.itemsize, 0, created) + np.array(rows, CHECK_RECORD).tobytes()


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


QUOTES = "path string, event_ix long, ts_ns long, best_bid double, best_ask double, bid_volume long, ask_volume long"
LEVELS = "array<struct<price:bigint,qty:bigint>>"
EVENTS = f"path string, symbol string, event_ix long, kind string, ts_ns long, event_ms long, first_id decimal(20,0), final_id decimal(20,0), bids {LEVELS}, asks {LEVELS}, trade_price long, trade_qty long, flags long"


def read_quotes(spark: SparkSession, path: str, pattern: str = "*.qbin", chunk: int = 65_536) -> DataFrame:
    """Quotes of all files below path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, rows = decode_quotes(data)
                for i in range(0, len(rows), chunk):
                    part = rows[i : i + chunk]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), *(pa.array(part[c].astype("f8" if c.startswith("best") else "i8")) for c in QUOTE_RECORD.names)], ["path", "event_ix", *QUOTE_RECORD.names])

    return _files(spark, path, pattern).mapInArrow(run, QUOTES)


def read_depth(spark: SparkSession, path: str, pattern: str = "*.l2bin", strict: bool = False) -> DataFrame:
    """Events of all depth files below path."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(EVENTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held = []
                for e in decode_depth(data, strict):
                    levels = {s: [{"price": p, "qty": q} for p, q in e[s]] for s in ("bids", "asks")}
                    held.append(e | {"path": name, "first_id": Decimal(e["first_id"]), "final_id": Decimal(e["final_id"])} | levels)
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return _files(spark, path, pattern).mapInArrow(run, EVENTS)


def depth_created(head: bytes) -> int:
    """Creation time in a depth file's header."""
    return DEPTH_HEADER.unpack(head)[7]


def read_checkpoints(spark: SparkSession, path: str, pattern: str = "*.l2bin") -> DataFrame:
    """path (of the recording), event_ix, update_id, state_hash (as text) of the checkpoint files beside depth files."""
    heads = _files(spark, path, pattern).select("path", F.substring("content", 1, DEPTH_HEADER.size).alias("head"))
    beside = _files(spark, path, f"{pattern}.l2chk").select(F.regexp_replace("path", r"\.l2chk$", "").alias("path"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, head, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = decode_checkpoints(data, depth_created(head))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(rows["event_index"].astype("i8")), pa.array(rows["update_id"].astype("i8")), pa.array([str(h) for h in rows["state_hash"].tolist()])], ["path", "event_ix", "update_id", "state_hash"])

    return heads.join(beside, "path").mapInArrow(run, "path string, event_ix long, update_id long, state_hash string")


def replay_changes(events: DataFrame) -> DataFrame:
    """Level changes (path, session_id, epoch, event_ix, ts_ns, side, price, qty, final_id) of depth events.

    Snapshots and boundaries start an epoch; sessions are the recordings, numbered by path (one row a recording).
    """
    numbers = events.select("path").distinct().withColumn("session_id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path")) - 1).cast("int"))
    rows = events.join(F.broadcast(numbers), "path").where("kind <> 'trade'")
    w = Window.partitionBy("session_id").orderBy("event_ix").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("epoch", F.sum((F.col("kind") != "depth").cast("int")).over(w).cast("long"))
    level = lambda s: F.transform(f"{s}s", lambda x: F.struct(F.lit(s).alias("side"), x["price"].alias("price"), x["qty"].alias("qty")))
    each = rows.select("path", "session_id", "epoch", "event_ix", "ts_ns", F.col("final_id").cast("long").alias("final_id"), F.posexplode(F.concat(level("bid"), level("ask"))).alias("part", "l"))
    return each.select("path", "session_id", "epoch", "event_ix", "ts_ns", "final_id", "part", "l.side", "l.price", "l.qty")


def verify_replay(spark: SparkSession, path: str) -> DataFrame:
    """path, checkpoints, mismatches: every checkpoint of the recordings below path against a replay of all their events.

    A checkpoint holds the update id and the hash of the book after an event; an event without levels has no state of
    its own and must not have one.
    """
    from ..operators import book

    changes = replay_changes(read_depth(spark, path))
    ids = changes.select("path", "session_id", "event_ix", "final_id").distinct()
    own = book.hashed(book.states(changes, None).join(ids, ["session_id", "event_ix"]), "final_id")
    seen = own.select("path", "event_ix", F.col("final_id").alias("_id"), F.col("state_hash").alias("_hash"))
    both = read_checkpoints(spark, path).join(seen, ["path", "event_ix"], "left")
    same = F.coalesce((F.col("_id") == F.col("update_id")) & (F.col("_hash") == F.col("state_hash")), F.lit(False))
    return both.groupBy("path").agg(F.count(F.lit(1)).alias("checkpoints"), F.count_if(~same).alias("mismatches"))


def completeness(events: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Each recording's event counts against its sidecar (path, clean_shutdown, queue_dropped, malformed, snapshots, depths, trades, boundaries); complete is null without a sidecar."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    counts = events.groupBy("path").agg(*(n(k) for k in KINDS.values()))
    both = counts.join(sidecars, "path", "left")
    same = (F.col("n_snapshot") == F.col("snapshots")) & (F.col("n_depth") == F.col("depths")) & (F.col("n_trade") == F.col("trades")) & (F.col("n_boundary") == F.col("boundaries"))
    good = F.col("clean_shutdown") & (F.col("queue_dropped") == 0) & (F.col("malformed") == 0) & (F.col("n_snapshot") > 0) & (F.col("n_depth") > 0)
    return both.select(*counts.columns, same.alias("counts_agree"), (good & same).alias("complete"))


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """path, record_index, kind: distinct boundaries of the sidecars below path, in order."""
    rows = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").schema("recording_file string, boundaries array<struct<record_index:bigint,kind:string>>").json(path)
    return rows.select(F.col("recording_file").alias("path"), F.explode("boundaries").alias("b")).select("path", "b.record_index", "b.kind").distinct().orderBy("path", "record_index")
