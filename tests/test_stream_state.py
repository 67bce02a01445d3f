import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from helpers import packet, packets_df, reference_flows
from pyspark.sql import functions as F
from test_flows import random_rows

from tidewire.operators.features import feature_columns, flow_features
from tidewire.operators.flows import FlowRules
from tidewire.schemas import FEATURE_NAMES
from tidewire.streaming import flows as SF
from tidewire.streaming import state as ST
from tidewire.streaming.score import closed_features


def machine(ts, flags, limit, is_open, fin):
    """One packet after the other: which close, and whether a FIN waits at the end."""
    closes, last = [], None
    for i, (t, f) in enumerate(zip(ts, flags)):
        if last is not None and t - last > limit:
            is_open = fin = False
        last = t
        closes.append(False)
        if not is_open:
            is_open, fin = True, False
            continue
        if (fin and f & 16 and not f & 2) or f & 4:
            closes[-1], is_open, fin = True, False, False
        elif f & 1:
            fin = True
    return closes, fin


@pytest.mark.parametrize("is_open,fin", [(False, False), (True, False), (True, True)])
def test_closings_equal_the_state_machine(is_open, fin):
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randrange(1, 14)
        ts = np.cumsum([rng.choice([0, 1, 5, 50]) for _ in range(n)]) + 100
        flags = np.array([rng.choice([16, 16, 2, 18, 1, 17, 4, 20, 21, 0]) for _ in range(n)])
        idle = np.diff(ts, prepend=ts[0]) > 20
        idle[0] = rng.random() < 0.3
        got, waits = ST.closings(ts, flags, idle, is_open, fin)
        before = (is_open, fin) if not idle[0] else (False, False)
        want, want_fin = machine(ts.tolist(), flags.tolist(), 20, *before)
        assert got.tolist() == want and waits == want_fin, (ts, flags, idle)


def test_moments_of_parts_add_up():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 10 ** 8, 400)
    for cut in (0, 1, 7, 399, 400):
        for a, b in zip(ST.merged(ST.moments(x[:cut]), ST.moments(x[cut:])), ST.moments(x)):
            assert a == pytest.approx(b, rel=1e-9)
    same = np.full(50, 60_010_000)
    assert ST.merged(ST.moments(same[:7]), ST.moments(same[7:]))[2:] == (0.0, 0.0, 0.0)


def test_bytes_of_payloads_survive_without_their_order():
    rng = random.Random(4)
    for size in (0, 1, 11, 12, 13, 300, 5000):
        for alphabet in (2, 256):
            payload = bytes(rng.randrange(alphabet) for _ in range(size))
            counts = np.zeros(256, np.int64)
            ST.add_bytes(counts, ST.byte_multiset(payload))
            assert counts.tolist() == np.bincount(np.frombuffer(payload, np.uint8), minlength=256).tolist()
            assert len(ST.byte_multiset(payload)) <= min(size, 5 * 256) + 1
    frame = pd.DataFrame({"ts_us": [5, 3], "packet_seq": [1, 2], "length": [9, 8], "payload_len": [2, 0], "tcp_flags": [1, 2], "from_lo": [True, False], "payload": [b"ab", None]})
    rows = ST.Rows.of(frame)
    back = ST.Rows.unpacked(*rows.packed())
    assert back.at.tobytes() == rows.at.tobytes() and back.heads == [b"ab", b""] and back.bytes == rows.bytes
    assert back.in_order().at["seq"].tolist() == [2, 1]


def test_many_gaps_are_summed_by_size():
    rng = np.random.default_rng(6)
    gaps = rng.integers(1, 1_000_000, 20_000)
    exact, rounded = (ST.FlowState(1, 0, 0, True, n_gaps=len(gaps), gap_sum=int(gaps.sum())) for _ in range(2))
    for part in np.array_split(gaps, 7):
        rounded.add_sizes(part)
    assert exact.active_us([gaps]) == gaps[gaps <= gaps.sum() // len(gaps)].sum()
    assert rounded.active_us([]) == pytest.approx(exact.active_us([gaps]), rel=0.1)


def with_payloads(rows, seed):
    rng = random.Random(seed)
    out = []
    for r in rows:
        payload = bytes(rng.choice(b"abcdef\x00\x01\xff") for _ in range(rng.choice([0, 0, 5, 14, 200])))
        ports = [53 if r[6] == 17 and p == 443 else p for p in r[4:6]]         # all UDP talks to port 53
        out.append((*r[:4], *ports, *r[6:8], len(payload), r[9], bytearray(payload)))
    return out


def land(spark, rows, path, pieces):
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    size = -(-len(ordered) // pieces)
    for i in range(0, len(ordered), size):
        packets_df(spark, ordered[i:i + size]).coalesce(1).write.mode("append").parquet(path)
    SF.heartbeat(spark, path, ordered[-1][1] + 400_000_000)


def stream(spark, rows, tmp_path, pieces, rules=FlowRules(), **kw):
    land(spark, rows, str(tmp_path / "in"), pieces)
    flows = SF.assign_flow_stream(SF.packet_stream(spark, str(tmp_path / "in"), files_per_batch=1), rules, **kw)
    progress = SF.run_available(flows, str(tmp_path / "out"), str(tmp_path / "cp"))
    return spark.read.parquet(str(tmp_path / "out")), progress


def test_all_features_equal_the_batch_plan(spark, tmp_path):
    rows = with_payloads(random_rows(31, 400, keys=4, gap_s=15), 5)
    got, _ = stream(spark, rows, tmp_path, 4, with_packets=False)
    assert got.filter("kind = 'packet'").isEmpty()
    key = ["flow_id", "start_us"]
    a = {(r.flow_id, r.start_us): r for r in feature_columns(closed_features(got), key).collect()}
    b = {(r.flow_id, r.start_us): r for r in feature_columns(flow_features(packets_df(spark, rows)), key).collect()}
    assert a.keys() == b.keys() and len(a) > 20
    for k in a:
        for name in FEATURE_NAMES:
            assert a[k][name] == pytest.approx(b[k][name], rel=1e-5, abs=1e-5), (k, name)
    assert any(r.dns_query_entropy > 0 for r in a.values()) and any(r.payload_entropy > 0 for r in a.values())


def test_one_heavy_conversation_and_many_batches(spark, tmp_path):
    """One conversation holds nearly all packets, in more batches than a query remembers, and parts of it wait in many buckets."""
    rng = random.Random(8)
    rows, ts = [], 10 ** 12
    for i in range(6000):
        ts += rng.choice([1, 1000, 400_000, 3_000_000])
        flags = rng.choice([16] * 40 + [17, 20])
        ends = (("10.0.0.1", 5), ("10.0.0.2", 80))[::rng.choice([1, -1])]
        rows.append(packet(i, ts, *ends, 6, flags, payload_len=3, payload=b"abc"))
        if i % 500 == 0:
            rows.append(packet(100_000 + i, ts, ("10.0.0.9", i), ("10.0.0.2", 80), 17))
    want = reference_flows(rows)
    got, progress = stream(spark, rows, tmp_path, 105)
    assert progress.batches > 100
    first = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        first.setdefault(want[r[0]][:2], r[0])
    packets = got.filter("kind = 'packet'").collect()
    assert {r.packet_seq: (r.flow_seq, r.is_fwd) for r in packets} == {s: (first[(k, no)], f) for s, (k, no, f) in want.items()}
    closed = got.filter("kind = 'closed'").agg(F.sum("total_packets").alias("n"), F.count(F.lit(1)).alias("flows")).first()
    assert (closed.n, closed.flows) == (len(rows), len(first))


def test_bounded_gap_list_is_reported(spark, tmp_path, monkeypatch):
    """The processor itself, with a plain stand-in for the engine's state."""
    class Value:
        def __init__(self): self.v = None
        def exists(self): return self.v is not None
        def get(self): return self.v
        def update(self, v): self.v = v
        def clear(self): self.v = None

    class Items(Value):
        def get(self): return iter(self.v or [])
        def appendValue(self, v): self.v = [*(self.v or []), v]

    class Table:
        def __init__(self): self.d = {}
        def containsKey(self, k): return k in self.d
        def getValue(self, k): return self.d[k]
        def updateValue(self, k, v): self.d[k] = v
        def removeKey(self, k): del self.d[k]
        def keys(self): return iter(list(self.d))
        def clear(self): self.d.clear()

    class Handle:
        def __init__(self): self.timers = set()
        def getValueState(self, *a): return Value()
        def getListState(self, *a): return Items()
        def getMapState(self, *a): return Table()
        def registerTimer(self, t): self.timers.add(t)
        def deleteTimer(self, t): self.timers.remove(t)

    class Now:
        def __init__(self, ms): self.ms = ms
        def getCurrentWatermarkInMs(self): return self.ms

    monkeypatch.setattr(SF, "MAX_GAPS", 50)
    handle, flows = Handle(), SF.Flows(120_000_000, 60_000_000, True, False)
    flows.init(handle)
    key = ("10.0.0.1", 1, "10.0.0.2", 2, 17)
    rng = np.random.default_rng(1)
    ts = np.cumsum(rng.integers(1000, 2_000_000, 400)) + 10 ** 12
    out = []
    for at in np.array_split(np.arange(400), 20):
        frame = pd.DataFrame({"packet_seq": at, "ts_us": ts[at], "from_lo": True, "length": 60, "payload_len": 0, "tcp_flags": 0, "payload": None})
        out += list(flows.handleInputRows(key, iter([frame]), Now(int(ts[at[-1]]) // 1000 - 10_000)))
        assert len(handle.timers) == 1
    assert not out and flows.flow.get()[0] == 0
    end = int(ts[-1]) // 1000 + 61_000
    out = list(flows.handleExpiredTimer(key, Now(end), type("E", (), {"getExpiryTimeInMs": lambda self: min(handle.timers)})()))
    row, gaps = pd.Series(json.loads(out[-1].summary.iloc[-1])), np.diff(ts)
    assert out[-1].kind.iloc[-1] == "closed" and row.total_packets == 400 and row.gap_sum == gaps.sum() and bool(row.gaps_rounded)
    assert row.active_us == pytest.approx(gaps[gaps <= gaps.mean()].sum(), rel=0.1)
    assert row.gap_std == pytest.approx(gaps.std()) and row.gap_mean == pytest.approx(gaps.mean()) and math.isfinite(row.gap_skew)
    assert flows.flow.v is None and flows.gaps.v is None and not flows.waiting.d
