"""Captures as a data source: `spark.read.format("capture")` and `spark.readStream.format("capture")`.

Batch: the source reads a kept index (`capture_index`, made by Spark jobs), one partition a range. Filters on times, files
and numbers are pushed into it: ranges that lie outside the times are never opened, and other frames are dropped before
they become rows. The options `host` and `port` drop frames whose bytes cannot hold such an address or port. That is a
necessary condition only, so whoever sets them filters the decoded columns too, as `captured_packets` does.

Streams: classic captures land in a folder and may still grow. An offset says how far each file was read, in bytes and
frames, always at the end of a whole record, so that any batch can be read again and a frame whose end has not landed yet
waits. The reader hops over the headers of new bytes to find the last whole record (`max_bytes` a batch and file); bodies
are read by tasks.
"""

from __future__ import annotations

import io
import ipaddress
import json
import operator
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from tidewire.functions import packets as P
from tidewire.functions.decode import OK, decode_frames, packets_of
from tidewire.session import scratch_dir
from tidewire.sources import capture as C
from tidewire.sources.tables import resolve_inputs

TESTS = {D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt,
         D.LessThanOrEqual: operator.le, D.In: lambda x, values: x in values}
#: Columns that are never null and known before a frame's bytes are copied.
PUSHED = ("packet_seq", "file", "frame_no", "ts_us", "linktype", "orig_len")


@dataclass
class Range(D.InputPartition):
    """Whole records of one file."""

    path: str
    file_no: int
    begin: int
    end: int
    first_frame: int
    state: str


def _needles(options: dict) -> list[list[bytes]]:
    """Groups of byte strings; a frame has to hold one of each group."""
    hosts = [ipaddress.ip_address(h.strip()).packed for h in options.get("host", "").split(",") if h.strip()]
    ports = [int(p) for p in options.get("port", "").split(",") if p.strip()]
    groups = [hosts] if hosts else []
    if ports and 0 not in ports:                     # packets without ports have port 0, which no byte shows
        groups.append([struct.pack(">H", p) for p in ports])
    return groups


def _batch(part: Range, numbers: list[int], rows: list[tuple]) -> pa.RecordBatch:
    ts, link, want, frame = zip(*rows)
    base = part.file_no << C.FILE_SHIFT
    return pa.RecordBatch.from_arrays([
        pa.array([base + n for n in numbers], pa.int64()), pa.array([part.path] * len(rows), pa.string()), pa.array(numbers, pa.int64()),
        pa.array(ts, pa.int64()), pa.array(link, pa.int32()), pa.array(want, pa.int32()), pa.array(frame, pa.binary())], C.CAPTURE_FRAMES.names)


def _frames(part: Range, tests: list[tuple], needles: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
    numbers, rows, base = [], [], part.file_no << C.FILE_SHIFT
    for number, row in enumerate(C.read_split(part.path, part.begin, part.end, part.state), part.first_frame):
        known = {"packet_seq": base + number, "file": part.path, "frame_no": number, "ts_us": row[0], "linktype": row[1], "orig_len": row[2]}
        if all(TESTS[kind](known[name], value) for kind, name, value in tests) and all(any(n in row[3] for n in group) for group in needles):
            numbers.append(number)
            rows.append(row)
            if len(rows) == C.BATCH_FRAMES:
                yield _batch(part, numbers, rows)
                numbers, rows = [], []
    if rows:
        yield _batch(part, numbers, rows)


class CaptureReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.index, self.needles, self.tests = options["path"], _needles(options), []
        first, last = (options.get("ranges") or ":").split(":")
        self.ranges = slice(int(first) if first else None, int(last) if last else None)

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in PUSHED and type(f) in TESTS and getattr(f, "value", 0) is not None:
                self.tests.append((type(f), name, f.value))
            elif not (name in PUSHED and isinstance(f, D.IsNotNull)):
                yield f

    def partitions(self) -> list[Range]:
        system, inner = C.file_system(self.index)
        table = ds.dataset(inner, filesystem=system, format="parquet").to_table().sort_by([("file_no", "ascending"), ("begin", "ascending")])
        found = table.to_pylist()[self.ranges]
        return [Range(r["file"], r["file_no"], r["begin"], r["end"], r["first_frame"], r["state"]) for r in found if self.may_hold(r)]

    def may_hold(self, r: dict) -> bool:
        for kind, name, value in self.tests:
            if name == "file" and not TESTS[kind](r["file"], value):
                return False
            if name == "ts_us" and r["low_us"] is not None:
                low, high = r["low_us"], r["high_us"]
                if kind in (D.EqualTo, D.In):
                    fits = any(low <= v <= high for v in (value if kind is D.In else [value]))
                else:                                # an end of the range shows whether any time in it can pass
                    fits = TESTS[kind](high if kind in (D.GreaterThan, D.GreaterThanOrEqual) else low, value)
                if not fits:
                    return False
        return True

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        return _frames(part, self.tests, self.needles) if part else iter(())       # None where no range is left


class CaptureStream(D.DataSourceStreamReader):
    """Offsets: {"next": file number, "files": {path: [file number, bytes, frames]}}, an entry for each file in the folder.

    The last offset is also kept in the folder `state`, since a restarted reader is not told where it was: so files keep their
    numbers, and are not hopped through again. If it is ahead of the query's checkpoint, the next batch is longer.
    """

    def __init__(self, options: dict):
        self.folder, self.glob, self.needles = options["path"], options.get("glob", "*.pcap"), _needles(options)
        self.kept = options["state"].rstrip("/") + "/offset.json"
        self.max_bytes, self.split_bytes = int(options.get("max_bytes", 1 << 33)), int(options.get("split_bytes", C.SPLIT_BYTES))

    def initialOffset(self) -> dict:
        return {"next": 0, "files": {}}

    def latestOffset(self) -> dict:
        from pyarrow import fs
        system, inner = C.file_system(self.kept)
        last = self.initialOffset()
        if system.get_file_info(inner).type == fs.FileType.File:
            with system.open_input_stream(inner) as f:
                last = json.loads(f.read())
        files, number = {}, last["next"]
        for path, size in self.landed():
            if path not in last["files"] and size < 24:
                continue                             # its header has not landed
            no, at, frames = last["files"].get(path, [None, 24, 0])
            if no is None:
                no, number = number, number + 1
            if at < size:
                with C.open_file(path) as raw:
                    order, ticks, _ = _classic(raw, path)
                    at, _, more, _, _ = C._hop(io.BufferedReader(raw, C.INDEX_BYTES), at, min(size, at + self.max_bytes), size, order, ticks)
                frames += more
            files[path] = [no, at, frames]
        found = {"next": number, "files": files}
        if found != last:
            system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(inner + ".new") as f:
                f.write(json.dumps(found).encode())
            system.move(inner + ".new", inner)
        return found

    def landed(self) -> list[tuple[str, int]]:
        from pyarrow import fs
        system, inner = C.file_system(self.folder)
        prefix = self.folder[:len(self.folder) - len(inner)] if self.folder.endswith(inner) else ""
        infos = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        return sorted((prefix + i.path, i.size) for i in infos if i.type == fs.FileType.File and fnmatch(i.base_name, self.glob))

    def partitions(self, start: dict, end: dict) -> list[Range]:
        parts = []
        for path, (no, stop, _) in end["files"].items():
            _, at, frames = start["files"].get(path, [no, 24, 0])
            if at >= stop:
                continue
            with C.open_file(path) as raw:
                order, ticks, link = _classic(raw, path)
                f = io.BufferedReader(raw, C.INDEX_BYTES)
                while at < stop:
                    to, _, more, _, _ = (stop, True, 0, 0, 0) if stop - at <= self.split_bytes else C._hop(f, at, at + self.split_bytes, stop, order, ticks)
                    parts.append(Range(path, no, at, to, frames, json.dumps(["pcap", order, ticks, link, []])))
                    at, frames = to, frames + more
        return parts

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return _frames(part, [], self.needles)


def _classic(f, path: str) -> tuple[str, int, int]:
    kind, order, ticks, link = C._header(f)
    if kind != "pcap":
        raise ValueError(f"only classic captures can be streamed: {path}")
    return order, ticks, link


class CaptureSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self):
        return C.CAPTURE_FRAMES

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(dict(self.options))

    def streamReader(self, schema) -> CaptureStream:
        return CaptureStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters be pushed to sources in Python."""
    spark.dataSource.register(CaptureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def kept_index(spark: SparkSession, pattern: str, split_bytes: int = C.SPLIT_BYTES) -> str:
    """The path of an index of all captures that match, for `spark.read.format("capture").load(path)`; it can be kept and used again."""
    path = scratch_dir(spark, "captures-index")
    C.capture_index(spark, resolve_inputs(spark, pattern), split_bytes).write.parquet(path)
    return path


def _any(test, values) -> Column:
    found = F.lit(False)
    for v in values:
        found = found | test(v)
    return found


def captured_packets(
    spark: SparkSession, index: str, hosts: tuple[str, ...] = (), ports: tuple[int, ...] = (),
    since_us: int | None = None, until_us: int | None = None,
) -> DataFrame:
    """Packets of one of the hosts, at one of the ports, with since_us <= time < until_us; a condition left out does not filter."""
    register(spark)
    frames = spark.read.format("capture").option("host", ",".join(hosts)).option("port", ",".join(map(str, ports))).load(index)
    if since_us is not None:
        frames = frames.where(F.col("ts_us") >= since_us)
    if until_us is not None:
        frames = frames.where(F.col("ts_us") < until_us)
    found = packets_of(decode_frames(frames))
    if hosts:
        found = found.where(_any(P.host, hosts))
    return found.where(_any(P.port, ports)) if ports else found


def first_packets(spark: SparkSession, index: str, max_packets: int) -> DataFrame:
    """The first `max_packets` decodable packets in file order, read from the first ranges that hold so many.

    Ranges are counted in file order, twice as many each time, until enough packets are found; later ones are not opened.
    """
    register(spark)
    source = spark.read.format("capture")
    total = spark.read.parquet(index).count()
    found, counted, more = 0, 0, 1
    while found < max_packets and counted < total:
        decoded = decode_frames(source.option("ranges", f"{counted}:{counted + more}").load(index))
        found += decoded.where(F.col("decode_status") == OK).count()
        counted, more = min(counted + more, total), more * 2
    return packets_of(decode_frames(source.option("ranges", f"0:{counted}").load(index))).orderBy("packet_seq").limit(max_packets)


def capture_stream(spark: SparkSession, folder: str, state: str, **options: str) -> DataFrame:
    """Packets of classic captures that land in a folder, which may still grow; each frame comes once.

    `state` is a folder of this stream's own, kept as long as its checkpoint.
    """
    register(spark)
    return packets_of(decode_frames(spark.readStream.format("capture").options(**options).option("state", state).load(folder)))
