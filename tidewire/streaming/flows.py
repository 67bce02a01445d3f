"""Flows on an unbounded table of packets.

`packet_stream` reads packets as they land. `assign_flow_stream` gives each packet its flow by the same rules as
the batch plan; state per conversation is what `state` describes: sums, and packets the watermark has not passed yet.
`stream_flow_stats` needs no custom state at all: idle-only sessions by `session_window`.

A stream ends flows when the watermark passes; `heartbeat` lands a row far ahead in time to flush everything.
"""

from __future__ import annotations

import json
import pickle
import threading
import time
from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass
from dataclasses import fields as fields_of
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidewire.functions.packets import flow_id, with_flow_key
from tidewire.operators.flows import FlowRules
from tidewire.schemas import FLOW_KEY, PACKETS, TCP, fields
from tidewire.streaming.state import MAX_GAPS, STATE, SUMMARY, FlowState, Rows, closings

HEARTBEAT_SEQ = -1
DEFAULT_DELAY = "10 seconds"


def packet_stream(
    spark: SparkSession, path: str, where: Column | None = None, files_per_batch: int | None = None,
) -> DataFrame:
    """Packets from Parquet files landing in a folder, with an optional predicate pushed to the scan."""
    reader = spark.readStream.schema(PACKETS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    packets = reader.parquet(path)
    if where is not None:
        packets = packets.filter(where | (F.col("packet_seq") == HEARTBEAT_SEQ))
    return packets


def heartbeat(spark: SparkSession, path: str, ts_us: int) -> None:
    """Lands one row that moves the watermark to `ts_us` (less the delay) and belongs to no conversation."""
    row = (HEARTBEAT_SEQ, ts_us, "", "", 0, 0, 0, 0, 0, 0, bytearray())
    spark.createDataFrame([row], PACKETS).coalesce(1).write.mode("append").parquet(path)


def with_event_time(packets: DataFrame, delay: str) -> DataFrame:
    return packets.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)


KEY_FIELDS = [T.StructField("lo_ip", T.StringType()), T.StructField("lo_port", T.IntegerType()),
              T.StructField("hi_ip", T.StringType()), T.StructField("hi_port", T.IntegerType()),
              T.StructField("protocol", T.IntegerType())]
CARRIED = ["packet_seq", "ts_us", "from_lo", "length", "payload_len", "tcp_flags", "payload"]
#: What leaves Python: few columns, as each costs time in every small table; totals of a closed flow are one JSON text.
OUT = T.StructType(KEY_FIELDS + fields("kind string, flow_seq bigint, packet_seq bigint, ts_us bigint, is_fwd boolean, iat_us bigint, summary string"))
TOTALS = [f.name for f in fields(SUMMARY)]
#: Waiting packets of one conversation are kept by stretches of time, so many to the idle limit.
BUCKETS = 8
#: While the waiting packets of one conversation take fewer bytes than this they lie in the flow's own row: one read and one write a batch.
FEW_BYTES = 1 << 18
#: Conversations are dealt over so many shards, each with one row of state that grows with its open conversations.
SHARDS = 1024
#: Rows of a table that leaves Python.
OUT_ROWS = 10_000
#: Where the timer stands in a stored row (`STATE`).
TIMER = -4


class Flows(StatefulProcessor):
    """One conversation: packets wait until the watermark passes them, then join the open flow in order of time.

    State: the open flow (sums only), the gaps of the open flow (a list of arrays, for `active_time`), and waiting packets: beside the
    open flow while they are few, else by bucket of time. One bucket is in memory at a time, however long the conversation is.
    """

    def __init__(self, tcp_us: int, other_us: int, teardown: bool, packets: bool, few_bytes: int = FEW_BYTES):
        self.tcp_us, self.other_us, self.teardown, self.packets, self.few_bytes = tcp_us, other_us, teardown, packets, few_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", STATE)
        self.gaps = handle.getListState("gaps", "data binary")
        self.waiting = handle.getMapState("waiting", "bucket bigint", "at binary, data binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):                      # the engine passes these by name
        for out in self.arrived(key, map(Rows.of, rows), timerValues.getCurrentWatermarkInMs() * 1000):
            yield self.frame([(key, out)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for out in self.due(key, timerValues.getCurrentWatermarkInMs() * 1000, expiredTimerInfo.getExpiryTimeInMs()):
            yield self.frame([(key, out)])

    def arrived(self, key: tuple, rows: Iterable[Rows], passed: int) -> Iterator[list[tuple]]:
        stored, few, buckets = self.stored()
        for new in rows:
            few.append(new)
            if buckets or sum(map(Rows.size, few)) > self.few_bytes:
                self.file(key, few, buckets)
        yield from self.advance(key, passed, stored, few, buckets, None)

    def due(self, key: tuple, passed: int, expired: int) -> Iterator[list[tuple]]:
        yield from self.advance(key, passed, *self.stored(), expired)

    def stored(self) -> tuple[tuple | None, list[Rows], set[int]]:
        """The open flow with its timer, and the packets that wait: in the row itself, or the buckets that hold them (never both)."""
        row = self.flow.get()
        if row is None:
            return None, [], set()
        *stored, at, data, buckets = row
        return tuple(stored), [Rows.unpacked(bytes(at), bytes(data))] if at else [], set(np.frombuffer(bytes(buckets), np.int64).tolist())

    def file(self, key: tuple, few: list[Rows], buckets: set[int]) -> None:
        """Moves packets into buckets."""
        new = Rows.joined(few)
        few.clear()
        bucket = new.at["ts"] // self.width(key)
        for b in np.unique(bucket).tolist():
            at, data = new.take(np.flatnonzero(bucket == b)).packed()
            if b in buckets:
                old = self.waiting.getValue((b,))
                at, data = old[0] + at, old[1] + data
            self.waiting.updateValue((b,), (at, data))
            buckets.add(b)

    def limit(self, key: tuple) -> int:
        return self.tcp_us if key[4] == TCP else self.other_us

    def width(self, key: tuple) -> int:
        return max(self.limit(key) // BUCKETS, 1)

    def advance(self, key: tuple, passed: int, stored: tuple | None, few: list[Rows], buckets: set[int], expired: int | None) -> Iterator[list[tuple]]:
        """Counts all packets the watermark has passed; what came before them is complete."""
        width, flow, timer = self.width(key), None, None
        if stored is not None:
            *values, timer = stored
            flow = FlowState(*[bytes(v) if isinstance(v, (bytes, bytearray)) else v for v in values]) if values[0] is not None else None
        if timer is not None and timer == expired:
            timer = None
        buckets = sorted(buckets)
        rest = [b for b in buckets if b * width > passed]
        first, out, left = rest[0] * width if rest else None, [], None
        for b in buckets[:len(buckets) - len(rest)] or [None] * bool(few):
            rows = (Rows.joined(few) if b is None else Rows.unpacked(*map(bytes, self.waiting.getValue((b,))))).in_order()
            ready = int(np.searchsorted(rows.at["ts"], passed, side="right"))
            if ready < len(rows.at):
                first = int(rows.at["ts"][ready])
                left = rows.take(np.arange(ready, len(rows.at)))
                if b is not None:
                    rest.append(b)
                    self.waiting.updateValue((b,), left.packed())
            elif b is not None:
                self.waiting.removeKey((b,))
            if ready:
                flow = self.counted(key, flow, rows.take(np.arange(ready)), out)
            if sum(len(o[0]) for o in out) > OUT_ROWS:
                yield out
                out = []
        if flow is not None and passed - flow.last_us > self.limit(key):
            out.append(self.closed(flow, []))
            flow = None
        if out:
            yield out
        due = [x for x in (first, None if flow is None else flow.last_us + self.limit(key)) if x is not None]
        want = max(min(due) // 1000 + 1, passed // 1000 + 1) if due else None
        if timer is not None and timer != want:
            self.handle.deleteTimer(timer)
        if want is not None and timer != want:
            self.handle.registerTimer(want)
        if flow is None and want is None:
            self.flow.clear()
        else:
            none = [None] * len(fields_of(FlowState))
            waiting = left.packed() if few and left is not None else (b"", b"")
            self.flow.update((*(astuple(flow) if flow is not None else none), want, *waiting, np.array(rest, np.int64).tobytes()))

    def counted(self, key: tuple, flow: FlowState | None, rows: Rows, out: list[tuple]) -> FlowState | None:
        """The flow that is open after the packets; `out` gets the packets and the flows that closed."""
        ts, flags, limit = rows.at["ts"], rows.at["flags"], self.limit(key)
        gap = np.diff(ts, prepend=ts[0] if flow is None else flow.last_us)
        idle = gap > limit
        closes, fin = np.zeros(len(ts), bool), False
        if self.teardown and key[4] == TCP:
            closes, fin = closings(ts, flags, idle, flow is not None, flow is not None and flow.fin)
        starts = idle.copy()
        starts[1:] |= closes[:-1]
        starts[0] |= flow is None
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(starts)])).tolist()
        kept = []
        for a, b in zip(cuts, [*cuts[1:], len(ts)]):
            if starts[a]:
                if flow is not None:
                    out.append(self.closed(flow, kept))
                    kept = []
                flow = FlowState(int(rows.at["seq"][a]), int(ts[a]), int(ts[a]), bool(rows.at["lo"][a]))
            here = np.arange(a, b)
            fwd = (rows.at["lo"][a:b] > 0) == flow.fwd_lo
            gaps = gap[a + 1:b] if starts[a] else gap[a:b]
            flow.add(rows.take(here), fwd, gaps)
            kept.append(gaps)
            if self.packets:
                before = gap[a:b].astype(object)
                if starts[a]:
                    before[0] = None
                n = b - a
                out.append((["packet"] * n, [flow.flow_seq] * n, rows.at["seq"][a:b].tolist(), ts[a:b].tolist(), fwd.tolist(), before.tolist(), [None] * n))
            if closes[b - 1]:
                out.append(self.closed(flow, kept))
                flow, kept = None, []
        if flow is not None:
            flow.fin = fin
            self.remember(flow, kept)
        return flow

    def remember(self, flow: FlowState, kept: list[np.ndarray]) -> None:
        """Gaps of the open flow, one by one while they are few."""
        new = np.concatenate(kept).astype("<i8") if kept else np.zeros(0, "<i8")
        if flow.n_gaps > MAX_GAPS:
            if not flow.gap_sizes:
                flow.add_sizes(np.zeros(0, np.int64))
                for old in self.old_gaps(flow):
                    flow.add_sizes(old)
                self.forget(flow)
            flow.add_sizes(new)
        elif len(new):
            self.gaps.appendValue((new.tobytes(),))
            flow.listed = True

    def old_gaps(self, flow: FlowState) -> Iterator[np.ndarray]:
        for (data,) in self.gaps.get() if flow.listed else ():
            yield np.frombuffer(bytes(data), "<i8")

    def forget(self, flow: FlowState) -> None:
        if flow.listed:
            self.gaps.clear()
            flow.listed = False

    def closed(self, flow: FlowState, kept: list[np.ndarray]) -> tuple:
        if flow.gap_sizes:
            for new in kept:
                flow.add_sizes(new)
        summary = json.dumps(dict(zip(TOTALS, flow.summary(chain(self.old_gaps(flow), kept)))))
        self.forget(flow)
        return ["closed"], [flow.flow_seq], [None], [None], [None], [None], [summary]

    @staticmethod
    def frame(parts: list[tuple[tuple, list[tuple]]]) -> pd.DataFrame:
        """One table of what several conversations gave out."""
        columns = [list(chain.from_iterable(c)) for c in zip(*[o for _, out in parts for o in out])]
        keys = zip(*[key for key, out in parts for o in out for _ in o[0]])
        return pd.DataFrame(dict(zip(OUT.names, [*map(list, keys), *columns])), dtype=object)


class Desk:
    """What `Flows` remembers of the conversation at hand (`name`): its row and few gaps in the shard's table, many gaps and
    packets in maps of the engine."""

    def __init__(self, waiting, gaps):
        self.waiting, self.gaps = waiting, gaps
        self.held: dict[str, list] = {}             # by conversation: row, gaps not yet moved, parts moved to the map
        self.name = ""

    def getValueState(self, *_):
        return self

    def getListState(self, *_):
        return Gaps(self)

    def getMapState(self, *_):
        return Waiting(self)

    def registerTimer(self, at: int) -> None:       # it stands in the row; the shard has the earliest one registered
        pass

    deleteTimer = registerTimer

    def entry(self) -> list:
        return self.held.setdefault(self.name, [None, b"", 0])

    def get(self) -> tuple | None:
        return self.held[self.name][0] if self.name in self.held else None

    def update(self, row: tuple) -> None:
        self.entry()[0] = row

    def clear(self) -> None:
        self.held.pop(self.name, None)


@dataclass
class Gaps:
    desk: Desk

    def appendValue(self, value: tuple[bytes]) -> None:
        entry = self.desk.entry()
        entry[1] += value[0]
        if len(entry[1]) > FEW_BYTES:
            self.desk.gaps.updateValue((self.desk.name, entry[2]), (entry[1],))
            entry[1:] = b"", entry[2] + 1

    def get(self) -> Iterator[tuple[bytes]]:
        _, few, parts = self.desk.entry()
        yield from (self.desk.gaps.getValue((self.desk.name, part)) for part in range(parts))
        if few:
            yield (few,)

    def clear(self) -> None:
        entry = self.desk.entry()
        for part in range(entry[2]):
            self.desk.gaps.removeKey((self.desk.name, part))
        entry[1:] = b"", 0


@dataclass
class Waiting:
    desk: Desk

    def getValue(self, bucket: tuple[int]) -> tuple[bytes, bytes]:
        return self.desk.waiting.getValue((self.desk.name, *bucket))

    def updateValue(self, bucket: tuple[int], value: tuple[bytes, bytes]) -> None:
        self.desk.waiting.updateValue((self.desk.name, *bucket), value)

    def removeKey(self, bucket: tuple[int]) -> None:
        self.desk.waiting.removeKey((self.desk.name, *bucket))


class Shards(StatefulProcessor):
    """Many conversations a call: each by the rules of `Flows`, its row kept in one table of the shard.

    A call of the engine, a row of its state, a timer and a table that leaves Python cost more than the packets of a short
    conversation, so they are shared. The shard has one timer, the earliest of its conversations.
    """

    def __init__(self, flows: Flows):
        self.flows = flows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.table = handle.getValueState("conversations", "data binary, timer bigint")
        self.desk = Desk(handle.getMapState("waiting", "conversation string, bucket bigint", "at binary, data binary"),
                         handle.getMapState("gaps", "conversation string, part bigint", "data binary"))
        self.flows.init(self.desk)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):                      # the engine passes these by name
        timer, passed = self.open(), timerValues.getCurrentWatermarkInMs() * 1000

        def visits():
            for frame in rows:
                every = Rows.of(frame)
                for name, where in frame.groupby("conversation", sort=False).indices.items():
                    yield name, lambda ends: self.flows.arrived(ends, [every.take(where)], passed)

        yield from self.visited(visits())
        self.save(timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        timer, now = self.open(), timerValues.getCurrentWatermarkInMs()
        due = [(name, at) for name, at in self.timers() if at <= now]
        yield from self.visited((name, lambda ends: self.flows.due(ends, now * 1000, at)) for name, at in due)
        self.save(None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)

    def visited(self, visits: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        """What the conversations give out, in tables of many rows."""
        parts, n = [], 0
        for name, work in visits:
            named = json.loads(name)
            self.desk.name, ends = name, tuple(named.get(c) for c in FLOW_KEY)
            for out in work(ends):
                parts.append((ends, out))
                n += sum(len(o[0]) for o in out)
                if n > OUT_ROWS:
                    yield self.flows.frame(parts)
                    parts, n = [], 0
        if parts:
            yield self.flows.frame(parts)

    def timers(self) -> Iterator[tuple[str, int]]:
        return ((name, row[TIMER]) for name, (row, _, _) in self.desk.held.items() if row is not None and row[TIMER] is not None)

    def open(self) -> int | None:
        """Reads the shard's table; its timer."""
        kept = self.table.get()
        self.desk.held = pickle.loads(bytes(kept[0])) if kept is not None else {}
        return kept[1] if kept is not None else None

    def save(self, timer: int | None) -> None:
        want = min((at for _, at in self.timers()), default=None)
        if timer is not None and timer != want:
            self.handle.deleteTimer(timer)
        if want is not None and timer != want:
            self.handle.registerTimer(want)
        if self.desk.held:
            self.table.update((pickle.dumps(self.desk.held, pickle.HIGHEST_PROTOCOL), want))
        else:
            self.table.clear()
        self.desk.held = {}


def conversation() -> Column:
    """The 5-tuple as one text; parts that are null are left out."""
    return F.to_json(F.struct(*FLOW_KEY))


def use_rocksdb(spark: SparkSession) -> None:
    """Flow state needs the RocksDB store; batches write what changed, not whole snapshots."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def assign_flow_stream(packets: DataFrame, rules: FlowRules = FlowRules(), delay: str = DEFAULT_DELAY, with_packets: bool = True,
                       few_bytes: int = FEW_BYTES, shards: int = SHARDS) -> DataFrame:
    """Rows of two kinds: `packet` (with its flow, unless not asked for) and `closed` (a flow that just ended, with its totals).

    In a stream `flow_seq` is the packet_seq of the flow's first packet, so closed conversations leave no state
    behind. Packets may come in any order within the watermark delay; later ones are dropped by the engine. Conversations are
    dealt over `shards`: the rows of one shard's conversations are in memory at a time.
    """
    use_rocksdb(packets.sparkSession)
    keyed = with_flow_key(with_event_time(packets, delay))
    processor = Flows(round(rules.tcp_seconds * 1e6), round(rules.udp_seconds * 1e6), rules.teardown, with_packets, few_bytes)
    shard = F.pmod(F.xxhash64(*FLOW_KEY), F.lit(shards))
    return (
        keyed.select(shard.alias("shard"), conversation().alias("conversation"), *CARRIED, "ts").groupBy("shard")
        .transformWithStateInPandas(Shards(processor), OUT, "append", "eventTime")
        .filter(F.col("flow_seq") != HEARTBEAT_SEQ)
        .withColumn("summary", F.from_json("summary", T.StructType(fields(SUMMARY)))).select(*OUT.names[:-1], "summary.*")
    )


def stream_flow_stats(packets: DataFrame, rules: FlowRules = FlowRules(), delay: str = DEFAULT_DELAY) -> DataFrame:
    """Idle-only sessions with counts, bytes and times; no Python state. Exact for UDP and ICMP.

    `session_window` merges packets whose distance is at most the limit, as the batch rule does. Sessions are merged where
    packets were read before they are dealt by conversation, so a busy one sends a few sessions, not its packets.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    keyed = with_flow_key(with_event_time(packets, delay))

    def interval(seconds):
        # a session ends `gap` after its last packet; one microsecond more keeps an exact gap inside
        return f"{round(seconds * 1_000_000) + 1} microseconds"

    gap = F.when(F.col("protocol") == TCP, interval(rules.tcp_seconds)).otherwise(interval(rules.udp_seconds))
    return keyed.groupBy(*FLOW_KEY, F.session_window("ts", gap)).agg(
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count(F.lit(1)).alias("total_packets"),
        F.sum("length").alias("total_bytes"), F.bit_or("tcp_flags").alias("flags"),
        F.max("packet_seq").alias("last_seq"),
        # a test on the aggregate: one on the rows would be moved below the watermark and hide heartbeats from it
    ).filter(F.col("last_seq") > HEARTBEAT_SEQ).select(flow_id().alias("flow_id"), "start_us", "end_us", "total_packets", "total_bytes", "flags")


class Progress(StreamingQueryListener):
    """Sums over every batch of one query, however many there are (a query itself remembers only its latest ones)."""

    def __init__(self):
        self.batches, self.rows, self.dropped_late = 0, 0, 0
        self.query_id, self.early, self.ended = None, [], threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        if self.query_id is None:
            self.early.append(event.progress)
        elif str(event.progress.runId) == self.query_id:
            self.add(event.progress)

    def follow(self, run_id: str) -> None:
        self.query_id = run_id
        for progress in self.early:
            if str(progress.runId) == run_id:
                self.add(progress)
        self.early = []

    def add(self, progress) -> None:
        self.batches += 1
        self.rows += progress.numInputRows
        self.dropped_late += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if self.query_id in (None, str(event.runId)):
            self.ended.set()


def run_available(stream: DataFrame, out: str, checkpoint: str) -> Progress:
    """Processes all that has landed, appends to Parquet, and returns sums over all batches."""
    progress = Progress()
    streams = stream.sparkSession.streams
    streams.addListener(progress)
    try:
        q = (
            stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out)
            .outputMode("append").trigger(availableNow=True).start()
        )
        progress.follow(str(q.runId))
        q.awaitTermination()
        progress.ended.wait(60)                 # events come after the query has ended
    finally:
        streams.removeListener(progress)
    return progress


def run_for(stream: DataFrame, out: str, checkpoint: str, packets: int | None = None, seconds: float | None = None,
            every: str = "1 second") -> Progress:
    """Runs on as packets land, and stops after the batch that brings the rows read to `packets`, or after `seconds`.

    Whole batches are processed, so a few more than `packets` may be read; what was read is written and committed.
    """
    progress = Progress()
    streams = stream.sparkSession.streams
    streams.addListener(progress)
    end = None if seconds is None else time.monotonic() + seconds
    try:
        q = (
            stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out)
            .outputMode("append").trigger(processingTime=every).start()
        )
        progress.follow(str(q.runId))
        while not q.awaitTermination(0.2):
            if (packets is not None and progress.rows >= packets) or (end is not None and time.monotonic() >= end):
                q.stop()
                break
        progress.ended.wait(60)
    finally:
        streams.removeListener(progress)
    return progress


def dropped_late(progress: Progress) -> int:
    """Rows that came behind the watermark, over all batches."""
    return progress.dropped_late
