"""Capture files (pcap, pcapng) as a table of frames.

A file is cut into byte ranges of about `split_bytes`, and one task a range finds the first record in it: a place where several
record headers follow each other. It hops on from there to the first record beyond the range, counting. A range was read
right if it starts where the one before it stopped; the first range starts after the file's header, so one after the other
is known to be right, and a range that took payload for headers is read again from where it has to start. Frame numbers are
sums of the counts. The index is made once and kept; then ranges are read, wherever there is room. So one large classic
capture is indexed and read by many tasks. In pcapng, where blocks before a range say how to read it, one task a file hops
over the headers.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.schemas import FRAMES, fields
from tidewire.session import scratch_dir
from tidewire.sources.tables import resolve_inputs

SPLIT_BYTES = 64 << 20
INDEX_BYTES = 8 << 20
BATCH_FRAMES = 8192
FILE_SHIFT = 40         # packet_seq = file number * 2^40 + frame number: unique, in file order

# Headers that have to follow each other; bytes searched at a time; a frame may always be so long
CHAIN, SEARCH_BYTES, LONGEST = 16, 1 << 20, 1 << 18
INDEX = T.StructType(fields("file string, file_no bigint, part bigint, low bigint, high bigint, start bigint, stop bigint, done boolean, frames bigint, first_frame bigint, state string, low_us bigint, high_us bigint"))
NULLABLE = {"start": "Int64", "stop": "Int64", "done": "boolean", "frames": "Int64", "first_frame": "Int64", "low_us": "Int64", "high_us": "Int64"}

CAPTURE_FRAMES = T.StructType([T.StructField("packet_seq", T.LongType())] + FRAMES.fields)

# --- fixed values: file formats ----------------------------------------------
PCAP_MAGIC = {0xA1B2C3D4: 1_000_000, 0xA1B23C4D: 1_000_000_000}
NG_SECTION, NG_INTERFACE, NG_SIMPLE, NG_PACKET, NG_OLD_PACKET = 0x0A0D0D0A, 1, 3, 6, 2
NG_BYTE_ORDER = 0x1A2B3C4D
OPT_TSRESOL, OPT_TSOFFSET = 9, 14


def arrow_uri(path: str) -> str:
    """Hadoop's names of object stores in the words Arrow knows them by."""
    scheme, rest = path.split("://", 1)
    if scheme in ("s3a", "s3n"):
        return f"s3://{rest}"
    if scheme in ("wasb", "wasbs"):
        return "abfss://" + rest.replace(".blob.core.windows.net", ".dfs.core.windows.net", 1)
    return path


def file_system(path: str):
    """(Arrow file system, path in it) for a local path or any URI that Arrow knows."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(arrow_uri(path))
    return fs.LocalFileSystem(), path


def open_file(path: str):
    """A seekable reader."""
    system, inner = file_system(path)
    return system.open_input_file(inner)


def _header(f):
    """(kind, byte order, ticks per second, link type) from the start of a file."""
    first = f.read(24)
    if len(first) >= 12 and struct.unpack("<I", first[:4])[0] == NG_SECTION:
        return "pcapng", "<", 0, 0
    if len(first) < 24:
        raise ValueError("not a capture file: too short")
    for order in "<>":
        magic = struct.unpack(order + "I", first[:4])[0]
        if magic in PCAP_MAGIC:
            return "pcap", order, PCAP_MAGIC[magic], struct.unpack(order + "I", first[20:24])[0] & 0x0FFFFFFF
    raise ValueError("not a capture file: unknown magic number")


def _interface(body: bytes, order: str) -> list:
    """[link type, ticks per second, offset seconds] of an interface block body."""
    link, ticks, shift, at = struct.unpack(order + "H", body[:2])[0], 1_000_000, 0, 8
    while at + 4 <= len(body):
        code, size = struct.unpack(order + "HH", body[at:at + 4])
        value = body[at + 4:at + 4 + size]
        if code == 0:
            break
        if code == OPT_TSRESOL and size:
            ticks = 2 ** (value[0] & 0x7F) if value[0] & 0x80 else 10 ** value[0]
        elif code == OPT_TSOFFSET and size == 8:
            shift = struct.unpack(order + "q", value)[0]
        at += 4 + (size + 3) // 4 * 4
    return [link, ticks, shift]


def _section_order(f, at: int) -> str:
    f.seek(at + 8)
    return "<" if struct.unpack("<I", f.read(4))[0] == NG_BYTE_ORDER else ">"


def plan_splits(path: str, split_bytes: int) -> Iterator[tuple]:
    """(offset, end, first frame number, state) of each split; frames never cross one.

    Reads headers and skips bodies. A file cut off in the middle of a record ends with the last whole one.
    """
    with open_file(path) as raw_file:
        size = raw_file.size()
        f = io.BufferedReader(raw_file, INDEX_BYTES)        # headers of many frames in one request
        kind, order, ticks, link = _header(f)
        interfaces: list = []
        at = begin = 24 if kind == "pcap" else 0
        frames = first = 0
        state = json.dumps([kind, order, ticks, link, interfaces])
        while at < size:
            fresh = False
            if kind == "pcap":
                if at + 16 > size:
                    break
                f.seek(at + 8)
                step = 16 + struct.unpack(order + "I", f.read(4))[0]
                is_frame = True
            else:
                if at + 12 > size:
                    break
                f.seek(at)
                raw = f.read(8)
                block = struct.unpack(order + "I", raw[:4])[0]
                if struct.unpack("<I", raw[:4])[0] == NG_SECTION:
                    order, interfaces, block, fresh = _section_order(f, at), [], NG_SECTION, True
                step = struct.unpack(order + "I", raw[4:8])[0]
                is_frame = block in (NG_PACKET, NG_SIMPLE, NG_OLD_PACKET)
            if step < 12 or at + step > size:
                break
            if (fresh or at - begin >= split_bytes) and at > begin:
                yield begin, at, first, state
                begin, first = at, frames
            if at == begin:
                state = json.dumps([kind, order, ticks, link, interfaces])
            if kind == "pcapng" and block == NG_INTERFACE:
                f.seek(at + 8)
                interfaces = interfaces + [_interface(f.read(step - 12), order)]
            frames += is_frame
            at += step
        if at > begin:
            yield begin, at, first, state


def read_split(path: str, begin: int, end: int, state: str) -> Iterator[tuple]:
    """(ts_us, link type, original length, frame bytes) of one split."""
    kind, order, ticks, link, interfaces = json.loads(state)
    with open_file(path) as f:
        f.seek(begin)
        data = memoryview(f.read(end - begin))
    at = 0
    while at < len(data):
        if kind == "pcap":
            sec, part, have, want = struct.unpack_from(order + "IIII", data, at)
            yield sec * 1_000_000 + part * 1_000_000 // ticks, link, want, bytes(data[at + 16:at + 16 + have])
            at += 16 + have
            continue
        block, step = struct.unpack_from(order + "II", data, at)
        if block == NG_SECTION or struct.unpack_from("<I", data, at)[0] == NG_SECTION:
            order = "<" if struct.unpack_from("<I", data, at + 8)[0] == NG_BYTE_ORDER else ">"
            step = struct.unpack_from(order + "I", data, at + 4)[0]
            interfaces = []
        elif block == NG_INTERFACE:
            interfaces = interfaces + [_interface(bytes(data[at + 8:at + step - 4]), order)]
        elif block in (NG_PACKET, NG_OLD_PACKET):
            shape = "IIIII" if block == NG_PACKET else "HHIIII"
            fields = struct.unpack_from(order + shape, data, at + 8)
            number, (high, low, have, want) = fields[0], fields[-4:]
            kind_of, per_second, shift = interfaces[number]
            stamp = ((high << 32) | low) * 1_000_000 // per_second + shift * 1_000_000
            yield stamp, kind_of, want, bytes(data[at + 28:at + 28 + have])
        elif block == NG_SIMPLE:
            want = struct.unpack_from(order + "I", data, at + 8)[0]
            yield 0, interfaces[0][0], want, bytes(data[at + 12:at + 12 + min(want, step - 16)])
        at += step


def _hop(f, at: int, high: int, size: int, order: str, ticks: int) -> tuple:
    """(place after the last whole record that starts before `high`, whether the file ends there, records passed, their first and last time)."""
    frames, low_us, high_us = 0, None, None
    while at < high:
        if at + 16 > size:
            return at, True, frames, low_us, high_us
        f.seek(at)
        sec, part, have = struct.unpack(order + "III", f.read(12))
        if at + 16 + have > size:
            return at, True, frames, low_us, high_us
        us = sec * 1_000_000 + part * 1_000_000 // ticks
        low_us, high_us = (us, us) if low_us is None else (min(low_us, us), max(high_us, us))
        at, frames = at + 16 + have, frames + 1
    return at, at >= size, frames, low_us, high_us


def _is_chain(f, at: int, size: int, order: str, ticks: int, longest: int) -> bool:
    """Do record headers that make sense follow each other from here?"""
    for _ in range(CHAIN):
        if at + 16 > size:
            return True
        f.seek(at)
        _, part, have, want = struct.unpack(order + "IIII", f.read(16))
        if part >= ticks or have > longest or want < have:
            return False
        at += 16 + have
    return True


def find_record(f, low: int, high: int, size: int, order: str, ticks: int, longest: int) -> int | None:
    """The first place in [low, high) from which a chain of records follows."""
    at = low
    while at < min(high, size - 15):
        n = min(SEARCH_BYTES, high - at, size - 15 - at)
        f.seek(at)
        data = np.frombuffer(f.read(n + 15), np.uint8)
        word = [data[k:k + n].astype(np.uint32) for k in range(16)]

        def number(k: int) -> np.ndarray:
            b = word[k:k + 4][::1 if order == "<" else -1]
            return b[0] | b[1] << 8 | b[2] << 16 | b[3] << 24

        have = number(8)
        for k in np.flatnonzero((number(4) < ticks) & (have <= longest) & (number(12) >= have)).tolist():
            if _is_chain(f, at + k, size, order, ticks, longest):
                return at + k
        at += n
    return None


def _ranges(split_bytes: int):
    """A row for each byte range of a file, without having looked into it; of pcapng files, the exact splits."""
    def run(batches):
        for pdf in batches:
            for path, number in zip(pdf["file"], pdf["file_no"]):
                with open_file(path) as f:
                    size = f.size()
                    kind, order, ticks, link = _header(f)
                if kind == "pcap":
                    state = json.dumps([kind, order, ticks, link, []])
                    rows = [(path, number, k, low, min(low + split_bytes, size), None, None, None, None, None, state, None, None)
                            for k, low in enumerate(range(24, size, split_bytes))]
                else:
                    rows = [(path, number, k, a, b, a, b, True, None, first, state, None, None) for k, (a, b, first, state) in enumerate(plan_splits(path, split_bytes))]
                yield pd.DataFrame(rows, columns=INDEX.names).astype(NULLABLE)
    return run


def _count(batches):
    """Fills in where records start and stop in a range, and how many start in it; `start` is followed where it is known."""
    for pdf in batches:
        rows = []
        for path, number, part, low, high, start, _, _, _, first, state, _, _ in pdf.itertuples(index=False):
            _, order, ticks, _, _ = json.loads(state)
            with open_file(path) as raw:
                size = raw.size()
                f = io.BufferedReader(raw, INDEX_BYTES)
                f.seek(16)
                longest = max(struct.unpack(order + "I", f.read(4))[0], LONGEST)
                if pd.isna(start):
                    start = low if part == 0 else find_record(f, low, high, size, order, ticks, longest)
                got = (None,) * 5 if start is None else (start, True, 0, None, None) if start < 0 else _hop(f, int(start), high, size, order, ticks)
            rows.append((path, number, part, low, high, start, *got[:3], first, state, *got[3:]))
        yield pd.DataFrame(rows, columns=INDEX.names).astype(NULLABLE)


def capture_index(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, file_no, begin, end, first_frame, state, low_us, high_us) of the ranges of all files, kept as a table.

    Times are null for pcapng.
    """
    def kept(df: DataFrame) -> DataFrame:
        path = scratch_dir(spark, "capture-index")
        df.write.parquet(path)
        return spark.read.schema(INDEX).parquet(path)

    files = spark.createDataFrame(list(zip(paths, range(len(paths)))), "file string, file_no bigint")
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = kept(files.repartition(min(len(paths), 10_000), "file_no").mapInPandas(_ranges(split_bytes), INDEX))
    exact = ranges.where("start IS NOT NULL")
    index = kept(ranges.where("start IS NULL").repartition(spread, "file_no", "part").mapInPandas(_count, INDEX))
    in_file = Window.partitionBy("file_no").orderBy("part")                 # a row for each `split_bytes` of one file
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    while True:
        # a range without a record passes on what the last one with records has said
        due = F.when(F.col("part") == 0, F.lit(24)).otherwise(F.last(F.when(F.col("done"), F.lit(-1)).otherwise(F.col("stop")), ignorenulls=True).over(before))
        checked = index.withColumn("due", due.cast("bigint"))
        wrong = checked.where(~F.col("start").eqNullSafe(F.col("due")))
        if wrong.isEmpty():
            break
        # at least the first wrong range of each file is now read from its true start; the others are checked again
        again = wrong.withColumn("start", F.col("due")).drop("due").repartition(spread, "file_no", "part").mapInPandas(_count, INDEX)
        index = kept(checked.where(F.col("start").eqNullSafe(F.col("due"))).drop("due").unionByName(again))
    counted = index.withColumn("first_frame", F.coalesce(F.sum("frames").over(before), F.lit(0))).where("frames > 0")
    return counted.unionByName(exact).select("file", "file_no", F.col("start").alias("begin"), F.col("stop").alias("end"), "first_frame", "state", "low_us", "high_us")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = CAPTURE_FRAMES.names

    def pack(path, base, first, rows):
        numbers = range(first, first + len(rows))
        ts, link, want, frame = zip(*rows)
        return pa.RecordBatch.from_arrays([
            pa.array([base + n for n in numbers], pa.int64()), pa.array([path] * len(rows), pa.string()),
            pa.array(numbers, pa.int64()), pa.array(ts, pa.int64()), pa.array(link, pa.int32()),
            pa.array(want, pa.int32()), pa.array(frame, pa.binary())], names)

    for batch in batches:
        for row in batch.to_pylist():
            rows, number = [], row["first_frame"]
            for frame in read_split(row["file"], row["begin"], row["end"], row["state"]):
                rows.append(frame)
                if len(rows) == BATCH_FRAMES:
                    yield pack(row["file"], row["file_no"] << FILE_SHIFT, number, rows)
                    number += len(rows)
                    rows = []
            if rows:
                yield pack(row["file"], row["file_no"] << FILE_SHIFT, number, rows)


def capture_scan(spark: SparkSession, pattern: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Frames of all capture files that match. `packet_seq` is unique and rises in file order."""
    paths = resolve_inputs(spark, pattern)
    spread = spark.sparkContext.defaultParallelism
    index = capture_index(spark, paths, split_bytes)
    return index.repartition(max(spread, len(paths)), "file_no", "begin").mapInArrow(_read, CAPTURE_FRAMES)
