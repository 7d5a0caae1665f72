"""Quote recordings: a file of fixed-width records, a file of update ids of equal length, and a JSON sidecar that comes last.

Recordings are listed on the driver, which reads headers and sidecars alone; records are read by ranges, so a long file
is many tasks, each of which pairs its records with the ids at the same places. Files are reached through Arrow's file
systems, on the driver as well as in tasks. A recording is complete (true), known not to be (false), or, without a
sidecar and ids, unknown (null).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codecs import IDS_HEADER, QUOTE_HEADER, QUOTE_RECORD, VOLUME_SCALE, decode_ids, decode_quotes, encode_checkpoints, encode_depth, encode_event, encode_ids, encode_quotes
from .scratch import folder

# What a sidecar says of every recording of this kind, and the types of its other fields.
SIDECAR = {"schema_version": 1, "binary_version": 1, "record_size": QUOTE_RECORD.itemsize, "volume_scale": VOLUME_SCALE, "source": "binance_spot", "symbol": "BTCUSDT", "stream": "bookTicker"}
NUMBERS = ("created_unix_ns", "recorded_records", "accepted_records", "recording_dropped", "recording_write_errors", "first_update_id", "last_update_id")
FLAGS = ("clean_shutdown", "data_complete")
ROWS = 1 << 20


@dataclass(frozen=True)
class Recording:
    path: str
    created: int
    records: int
    ids: str | None
    complete: bool | None
    boundaries: tuple[tuple[int, str], ...]
    first_id: int | None = None
    last_id: int | None = None


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _refuse(good: bool, path: str, what: str) -> None:
    if not good:
        raise ValueError(f"{path}: {what}")


def _sidecar(text: str, path: str, records: int) -> dict:
    """A sidecar's fields, of the right types, with its boundaries sorted and each once."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"{path}: {e}") from e
    _refuse(isinstance(found, dict), path, "the sidecar is no object")
    for field, value in SIDECAR.items():
        _refuse(type(found.get(field, value)) is type(value) and found.get(field, value) == value and (field in found or isinstance(value, int) and field != "schema_version"), path, f"{field} is not {value}")
    _refuse(all(type(found[x]) is int and found[x] >= 0 for x in NUMBERS if found.get(x) is not None), path, "a count or id is no whole number")
    _refuse(all(type(found.get(x)) is bool for x in FLAGS), path, "clean_shutdown and data_complete must be given")
    _refuse("update_id_file" in found, path, "no id file is named")
    _refuse(found.get("recording_file", os.path.basename(path)) == os.path.basename(path), path, "the sidecar is another recording's")
    marks = found.get("boundaries", [])
    _refuse(isinstance(marks, list) and all(isinstance(b, dict) and type(b.get("record_index")) is int and 0 <= b["record_index"] <= records and isinstance(b.get("kind"), str) and b["kind"].strip() for b in marks), path, "a boundary is malformed")
    return found | {"boundaries": tuple(sorted({(b["record_index"], b["kind"].strip()) for b in marks}))}


def inspect(path: str) -> Recording:
    """What a recording's header, sidecar and id file say; an error if they contradict each other."""
    files, at = store(path)
    exists = lambda p: files.get_file_info(p).type == fs.FileType.File
    with files.open_input_file(at) as f:
        size = f.size()
        header = f.read(QUOTE_HEADER.size)
        created, _ = decode_quotes(header)
    _refuse((size - QUOTE_HEADER.size) % QUOTE_RECORD.itemsize == 0, path, "ends with part of a record")
    records = (size - QUOTE_HEADER.size) // QUOTE_RECORD.itemsize
    own: dict = {}
    if exists(f"{at}.meta.json"):
        with files.open_input_file(f"{at}.meta.json") as f:
            own = _sidecar(f.read().decode(), path, records)
    ids = f"{os.path.dirname(at)}/{own['update_id_file']}" if own.get("update_id_file") else f"{at}.qids" if exists(f"{at}.qids") else None
    first = last = n_ids = None
    if ids:
        with files.open_input_file(ids) as f:
            n_ids = (f.size() - IDS_HEADER.size) // 8
            head = f.read(IDS_HEADER.size)
            decode_ids(head, created)
            if n_ids > 0:
                first = int.from_bytes(f.read(8), "little")
                f.seek(IDS_HEADER.size + 8 * (n_ids - 1))
                last = int.from_bytes(f.read(8), "little")
    if own:
        _refuse(own.get("created_unix_ns") == created, path, "the sidecar has another time of creation")
        _refuse(own.get("recorded_records") in (None, records), path, "the sidecar has another number of records")
        _refuse(own.get("accepted_records") is None or records <= own["accepted_records"], path, "more records than were accepted")
        for field, seen in (("first_update_id", first), ("last_update_id", last)):
            _refuse(own.get(field) in (None, 0) or own[field] == seen, path, f"{field} is not that of the id file")
        whole = own["clean_shutdown"] and own.get("recording_dropped") == 0 == own.get("recording_write_errors") and own.get("accepted_records") == records == n_ids
        _refuse(whole or not own["data_complete"], path, "called complete, but it is not")
    # ids without a sidecar: the recorder was stopped before its end
    complete = own["data_complete"] if own else False if ids else None
    return Recording(path, created, records, ids, complete, own.get("boundaries", ()), first, last)


def discover(path: str) -> list[Recording]:
    """The recordings below path, the oldest first."""
    files, at = store(path)
    found = files.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((inspect(prefix + f.path) for f in found if f.type == fs.FileType.File and f.path.endswith(".qbin")), key=lambda r: (r.created, r.path))


def _range(path: str, ids: str | None, created: int, start: int, stop: int) -> pa.RecordBatch:
    """Records of a recording, beside their ids (which must grow, also from the one before)."""
    files, at = store(path)
    with files.open_input_file(at) as f:
        f.seek(QUOTE_HEADER.size + start * QUOTE_RECORD.itemsize)
        rows = np.frombuffer(f.read((stop - start) * QUOTE_RECORD.itemsize), QUOTE_RECORD)
    columns = [pa.array([path] * len(rows)), pa.array(np.arange(start, start + len(rows))), *(pa.array(rows[c].astype("f8" if c.startswith("best") else "i8")) for c in QUOTE_RECORD.names)]
    if ids is None:
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), pa.int64())], [*_NAMES])
    with files.open_input_file(ids) as f:
        before = min(start, 1)
        f.seek(IDS_HEADER.size + 8 * (start - before))
        own = decode_ids(encode_ids(created, np.frombuffer(f.read(8 * (stop - start + before)), "<u8")), created)[before:]
    paired = np.zeros(len(rows), np.int64)
    paired[: len(own)] = own.astype(np.int64)
    return pa.RecordBatch.from_arrays([*columns, pa.array(paired, mask=np.arange(len(rows)) >= len(own))], [*_NAMES])


_NAMES = ("recording", "event_ix", *QUOTE_RECORD.names, "update_id")


def read_recordings(spark: SparkSession, path: str, rows: int = ROWS, require_complete: bool = False) -> DataFrame:
    """recording, event_ix (place in it), ts_ns, best_bid, best_ask, bid_volume, ask_volume, update_id of all recordings below path.

    update_id is null where a recording has no ids (or fewer). An empty folder gives an empty result.
    """
    found = discover(path)
    if require_complete and (bad := [r.path for r in found if r.complete is not True]):
        raise ValueError(f"not known to be complete: {bad}")
    parts = [(r.path, r.ids, r.created, i, min(i + rows, r.records)) for r in found for i in range(0, r.records, rows)]
    ranges = spark.createDataFrame(parts, "path string, ids string, created long, start long, stop long").repartition(max(1, len(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.to_pylist():
                yield _range(**part)

    return ranges.mapInArrow(run, "recording string, event_ix long, ts_ns long, best_bid double, best_ask double, bid_volume long, ask_volume long, update_id long")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """recording, created, records, complete and boundaries of all recordings below path."""
    rows = [(r.path, r.created, r.records, r.complete, list(r.boundaries)) for r in discover(path)]
    return spark.createDataFrame(rows, "recording string, created long, records long, complete boolean, boundaries array<struct<record_index:long,kind:string>>")


def write_recordings(quotes: DataFrame, path: str, batch: int = 4096) -> list[Recording]:
    """Writes each session of quotes (session_id, event_ix, ts_ns, prices, volumes, update_id) as a recording below path.

    Rows stream into files of a name of their own; records, ids and, last, the sidecar are then moved into place. A
    recording that is there already is an error, unless this very call wrote it (a task that runs again).
    """
    call = uuid.uuid4().hex
    names = ("ts_ns", "best_bid", "best_ask", "bid_volume", "ask_volume")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(path)
        files.create_dir(root, recursive=True)
        current, sinks, count, ids = None, [], 0, [0, 0]

        def close() -> str:
            for s in sinks:
                s.close()
            target = f"{root}/session-{current}.qbin"
            if files.get_file_info(f"{target}.meta.json").type != fs.FileType.NotFound:
                with files.open_input_file(f"{target}.meta.json") as f:
                    if json.loads(f.read()).get("writer") != call:
                        raise FileExistsError(target)
            side = SIDECAR | {"recording_file": os.path.basename(target), "update_id_file": f"{os.path.basename(target)}.qids", "created_unix_ns": current + 1, "recorded_records": count, "accepted_records": count, "recording_dropped": 0, "recording_write_errors": 0, "first_update_id": ids[0], "last_update_id": ids[1], "clean_shutdown": True, "data_complete": True, "boundaries": [], "writer": call}
            with files.open_output_stream(f"{target}.{part}.json") as f:
                f.write(json.dumps(side).encode())
            for source, end in ((f"{target}.{part}.ids", ".qids"), (f"{target}.{part}", ""), (f"{target}.{part}.json", ".meta.json")):
                files.move(source, f"{target}{end}")
            return target

        for b in batches:
            rows = b.to_pydict()
            keys = np.array(rows["session_id"])
            for a in np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist() if len(keys) else ():
                z = a + int((np.cumsum(keys[a:] != keys[a]) == 0).sum())
                if keys[a] != current:
                    if sinks:
                        yield pa.RecordBatch.from_pydict({"recording": [close()]})
                    current, part, count = int(keys[a]), uuid.uuid4().hex, 0
                    base = f"{root}/session-{current}.qbin.{part}"
                    sinks = [files.open_output_stream(base), files.open_output_stream(f"{base}.ids")]
                    sinks[0].write(encode_quotes(current + 1, np.zeros(0, QUOTE_RECORD)))
                    sinks[1].write(encode_ids(current + 1, np.zeros(0, "<u8")))
                    ids[0] = rows["update_id"][a]
                own = np.zeros(z - a, QUOTE_RECORD)
                for c in names:
                    own[c] = rows[c][a:z]
                sinks[0].write(own.tobytes())
                sinks[1].write(np.array(rows["update_id"][a:z], "<u8").tobytes())
                count, ids[1] = count + z - a, rows["update_id"][z - 1]
        if sinks:
            yield pa.RecordBatch.from_pydict({"recording": [close()]})

    ordered = quotes.select("session_id", "event_ix", *names, "update_id").repartition("session_id").sortWithinPartitions("session_id", "event_ix")
    written = ordered.mapInArrow(run, "recording string").collect()  # one row a session
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    return [inspect(prefix + r.recording) for r in sorted(written)]


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{folder(spark)}/recordings-{uuid.uuid4().hex}"


def write_depth(events: DataFrame, path: str, symbol: str, every: int = 1_000) -> None:
    """Writes each session of events (as the simulator takes them) as a depth file with checkpoints below path.

    A checkpoint follows the first event with levels after each `every` events. Files get their names when whole; a
    file that is there already is replaced only by the same session's task running again.
    """
    from ..operators.book import Book, state_hash

    call = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(path)
        files.create_dir(root, recursive=True)
        current, sink, book, checks, place = None, None, Book(), [], 0

        def close() -> None:
            sink.close()
            name = f"{root}/session-{current}.l2bin"
            with files.open_output_stream(f"{name}.{call}.l2chk") as f:
                f.write(encode_checkpoints(current + 1, checks))
            files.move(f"{name}.{call}.l2chk", f"{name}.l2chk")
            files.move(f"{name}.{call}", name)

        for b in batches:
            for r in b.to_pylist():
                if r["session_id"] != current:
                    if sink:
                        close()
                    current, book, checks, place = r["session_id"], Book(), [], 0
                    sink = files.open_output_stream(f"{root}/session-{current}.l2bin.{call}")
                    sink.write(encode_depth(current + 1, symbol, []))
                levels = {s: [(x["price"], x["qty"]) for x in r[f"{s}s"] or []] for s in ("bid", "ask")}
                traded = r["kind"] == "trade"
                sink.write(encode_event(r["kind"], r["ts_ns"], 0, 1 if traded else r["first_id"], 0 if traded else r["final_id"], levels["bid"], levels["ask"], r["trade_price"] or 0, r["trade_qty"] or 0, int(bool(r["buyer_is_maker"]))))
                if r["kind"] == "snapshot":
                    book = Book()
                for side, own in levels.items():
                    for price, qty in own:
                        book.set(side, price, qty)
                if (levels["bid"] or levels["ask"]) and place >= every * (len(checks) + 1):
                    checks.append((place, r["final_id"], state_hash(r["final_id"], book.best("bid"), book.best("ask"))))
                place += 1
        if sink:
            close()
        yield from ()

    rows = events.repartition("session_id").sortWithinPartitions("session_id", "event_ix")
    rows.mapInArrow(run, "done int").collect()  # no rows
