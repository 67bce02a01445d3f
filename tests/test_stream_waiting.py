import random

import numpy as np
import pandas as pd
import pytest
from helpers import packet, packets_df, reference_flows
from pyspark.sql import functions as F

from tidewire.plans import catalog
from tidewire.plans import fixtures as X
from tidewire.streaming import flows as SF


@pytest.fixture
def many_files(spark, tmp_path):
    """The events table in six files, as larger tables come in."""
    X.table(spark, "/root/testdata/sf0.001", "events").repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["stream_flow_stats", "stream_flush", "packet_stream"])
def test_loads_of_several_files_are_read_whole(spark, many_files, name):
    """Files of a load overlap in time; read one by one, the later ones came behind the watermark and were dropped."""
    got = catalog.queries()[name](spark, many_files)
    want = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    if name != "packet_stream":
        n = got.agg(F.sum("total_packets" if name == "stream_flow_stats" else "n_packets")).first()[0]
        assert n == X.table(spark, many_files, "events").count()


@pytest.mark.parametrize("few_bytes", [0, 2000, 1 << 18])
def test_waiting_packets_in_the_row_and_in_buckets(spark, tmp_path, few_bytes):
    rng, rows, ts = random.Random(8), [], 10 ** 12
    for i in range(900):
        ts += rng.choice([1, 1000, 400_000, 3_000_000, 70_000_000])
        ends = (("10.0.0.1", 5), ("10.0.0.2", 80))[::rng.choice([1, -1])]
        rows.append(packet(i, ts, *ends, rng.choice([6, 17]), rng.choice([16] * 20 + [17, 20]), payload_len=3, payload=b"abc"))
    path = str(tmp_path / "in")
    for part in range(4):
        packets_df(spark, rows[part * 225:(part + 1) * 225]).coalesce(1).write.mode("append").parquet(path)
    SF.heartbeat(spark, path, ts + 400_000_000)
    SF.run_available(SF.assign_flow_stream(SF.packet_stream(spark, path, files_per_batch=1), few_bytes=few_bytes),
                     str(tmp_path / "out"), str(tmp_path / "cp"))
    got, want, first = spark.read.parquet(str(tmp_path / "out")), reference_flows(rows), {}
    for r in rows:
        first.setdefault(want[r[0]][:2], r[0])
    assert {r.packet_seq: (r.flow_seq, r.is_fwd) for r in got.filter("kind = 'packet'").collect()} == {
        s: (first[(k, no)], f) for s, (k, no, f) in want.items()}
    closed = got.filter("kind = 'closed'").agg(F.sum("total_packets").alias("n"), F.count(F.lit(1)).alias("flows")).first()
    assert (closed.n, closed.flows) == (len(rows), len(first))


def test_few_waiting_packets_cost_few_calls(spark):
    """A conversation of forty packets hours apart: one read and one write of its row a batch, whatever stretches they lie in."""
    calls = []

    class State:
        def __init__(self): self.v, self.d = None, {}
        def get(self): calls.append("get"); return self.v
        def update(self, v): calls.append("update"); self.v = v
        def clear(self): calls.append("clear"); self.v = None
        def getValue(self, k): calls.append("getValue"); return self.d[k]
        def updateValue(self, k, v): calls.append("updateValue"); self.d[k] = v
        def removeKey(self, k): calls.append("removeKey"); del self.d[k]
        def appendValue(self, v): calls.append("append")

    class Handle:
        def getValueState(self, *a): return State()
        def getListState(self, *a): return State()
        def getMapState(self, *a): return State()
        def registerTimer(self, t): pass
        def deleteTimer(self, t): pass

    class Now:
        def __init__(self, ms): self.ms = ms
        def getCurrentWatermarkInMs(self): return self.ms

    flows, key = SF.Flows(43_200_000_000, 21_600_000_000, True, False), ("10.0.0.1", 1, "10.0.0.2", 2, 17)
    flows.init(Handle())
    ts = 10 ** 15 + np.arange(40) * 36_000_000_000
    frame = pd.DataFrame({"packet_seq": np.arange(40), "ts_us": ts, "from_lo": True, "length": 60, "payload_len": 0, "tcp_flags": 0, "payload": None})
    assert not list(flows.handleInputRows(key, iter([frame]), Now(0))) and calls == ["get", "update"]
    calls.clear()
    end = type("E", (), {"getExpiryTimeInMs": lambda self: 0})()
    out = list(flows.handleExpiredTimer(key, Now(int(ts[-1]) // 1000 + 30_000_000), end))
    assert sum(len(o) for o in out) == 40 and calls == ["get", "clear"]
