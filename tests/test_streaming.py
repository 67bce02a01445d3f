import pytest
from helpers import packets_df, reference_flows
from pyspark.sql import functions as F
from test_flows import random_rows

from tidewire.operators.features import flow_features
from tidewire.operators.flows import FlowRules
from tidewire.streaming import flows as SF
from tidewire.streaming.score import closed_features


def land(spark, rows, path, pieces=3):
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    size = -(-len(ordered) // pieces)
    for i in range(0, len(ordered), size):
        packets_df(spark, ordered[i:i + size]).coalesce(1).write.mode("append").parquet(path)
    SF.heartbeat(spark, path, ordered[-1][1] + 400_000_000)


@pytest.mark.parametrize("chunk_rows", [10_000, 4])
def test_stream_equals_batch(spark, tmp_path, chunk_rows):
    rows = random_rows(21, 200, keys=3, gap_s=15)
    path, rules = str(tmp_path / "in"), FlowRules(chunk_rows=chunk_rows)
    land(spark, rows, path)
    stream = SF.assign_flow_stream(SF.packet_stream(spark, path, files_per_batch=1), rules)
    SF.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    flows = reference_flows(rows)
    first = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        first.setdefault(flows[r[0]][:2], r[0])
    packets = got.filter("kind = 'packet'").collect()
    assert {r.packet_seq: (r.flow_seq, r.is_fwd) for r in packets} == {
        seq: (first[(key, no)], fwd) for seq, (key, no, fwd) in flows.items()}
    closed = got.filter("kind = 'closed'").collect()
    assert sorted(r.flow_seq for r in closed) == sorted(first.values())       # all flushed, each once
    names = ["iat_std", "active_time", "payload_entropy", "beacon_score", "total_bytes", "rst_flag"]
    shape = [F.round(F.col("features")[n].cast("double"), 3).alias(n) for n in names]
    a = closed_features(got.filter("kind = 'closed'")).select("flow_id", "start_us", *shape)
    b = flow_features(packets_df(spark, rows)).select("flow_id", "start_us", *shape)
    assert sorted(a.collect()) == sorted(b.collect())


def test_sessions_and_late_rows(spark, tmp_path):
    rows = [r for r in random_rows(22, 300, keys=3, gap_s=40)]
    path = str(tmp_path / "in")
    land(spark, rows, path, pieces=2)
    late = sorted(rows, key=lambda r: r[1])[0]
    packets_df(spark, [(9999, *late[1:])]).coalesce(1).write.mode("append").parquet(path)
    progress = SF.run_available(
        SF.stream_flow_stats(SF.packet_stream(spark, path, files_per_batch=1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert SF.dropped_late(progress) == 1
    got = spark.read.parquet(str(tmp_path / "out"))
    want = {}
    seen = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        ends = sorted([(r[2], r[4]), (r[3], r[5])])
        key = (*ends[0], *ends[1], r[6])
        limit = 120_000_000 if r[6] == 6 else 60_000_000
        if key not in seen or r[1] - seen[key][1] > limit:
            seen[key] = [r[1], r[1], 0]
            want.setdefault(key, []).append(seen[key])
        seen[key][1] = r[1]
        seen[key][2] += 1
    assert sorted((r.start_us, r.end_us, r.total_packets) for r in got.collect()) == sorted(
        tuple(s) for v in want.values() for s in v)
