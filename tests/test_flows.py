import random

import pytest
from helpers import packet, packets_df, reference_flows

from tidewire.functions.packets import with_flow_key
from tidewire.operators import teardown
from tidewire.operators.flows import FlowRules, assign_flows, find_chunks, long_enough, side_gaps, summarise_flows
from tidewire.schemas import FLOW_KEY


def assigned(spark, rows, **rules):
    df = assign_flows(packets_df(spark, rows), FlowRules(**rules))
    return {
        r.packet_seq: ((r.lo_ip, r.lo_port, r.hi_ip, r.hi_port, r.protocol), r.flow_seq, r.is_fwd)
        for r in df.collect()
    }


def random_rows(seed, n, keys=3, gap_s=40):
    rng = random.Random(seed)
    rows, ts = [], 1_000_000_000_000
    for i in range(n):
        ts += rng.choice([0, 1, 1000, rng.randrange(1, gap_s * 1_000_000)])
        k = 0 if rng.random() < 0.5 else rng.randrange(keys)
        a, b = ("10.0.0.%d" % k, 1000 + k), ("10.1.0.1", 443)
        if rng.random() < 0.5:
            a, b = b, a
        proto = [6, 6, 17, 1][k % 4]
        if proto == 1:
            a, b = (a[0], 0), (b[0], 0)
        flags = rng.choice([16, 16, 24, 2, 18, 1, 17, 4, 20, 21, 0]) if proto == 6 else 0
        rows.append(packet(i, ts, a, b, proto, flags, length=40 + rng.randrange(100), payload_len=rng.randrange(100)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_assignment_equals_state_machine(spark, seed):
    rows = random_rows(seed, 600, keys=4)
    assert assigned(spark, rows) == reference_flows(rows)


@pytest.mark.parametrize("seed,chunk_rows", [(10, 7), (11, 3), (12, 40), (13, 1)])
def test_heavy_conversation_in_chunks_equals_state_machine(spark, seed, chunk_rows):
    rows = random_rows(seed, 500, keys=3, gap_s=20)
    assert find_chunks(packets_df(spark, rows), FlowRules(chunk_rows=chunk_rows)) is not None
    assert assigned(spark, rows, chunk_rows=chunk_rows) == reference_flows(rows)


@pytest.mark.parametrize("flags,sizes", [
    ((4, 16, 16), [3]), ((16, 4, 4, 16), [2, 2]), ((17, 16, 16), [3]), ((16, 17, 16, 16), [3, 1]),
    ((16, 17, 17, 16), [3, 1]), ((16, 1, 18, 16), [4]), ((16, 17, 20, 16), [3, 1]),
])
@pytest.mark.parametrize("chunk_rows", [100, 1])
def test_teardown_edges(spark, flags, sizes, chunk_rows):
    rows = [packet(i, 1_000_000 + i, flags=f) for i, f in enumerate(flags)]
    flows = summarise_flows(assign_flows(packets_df(spark, rows), FlowRules(chunk_rows=chunk_rows)))
    assert [r.total_packets for r in flows.orderBy("flow_seq").collect()] == sizes


def test_idle_limit_is_strict(spark):
    for proto, limit in ((6, 120_000_000), (17, 60_000_000), (1, 60_000_000)):
        for extra, n in ((0, 1), (1, 2)):
            rows = [packet(0, 10, proto=proto), packet(1, 10 + limit + extra, proto=proto)]
            assert summarise_flows(assign_flows(packets_df(spark, rows))).count() == n


def test_tcp_conversation(spark):
    a, b, t = ("10.0.0.1", 54321), ("10.0.0.2", 443), 1_000_000_000_000
    rows = [
        packet(0, t, a, b, flags=2, length=60), packet(1, t + 50_000, b, a, flags=18, length=60),
        packet(2, t + 100_000, a, b, flags=16, length=512, payload_len=452),
        packet(3, t + 3_000_000, a, b, flags=17, length=40), packet(4, t + 3_020_000, b, a, flags=16, length=40),
    ]
    flow, = long_enough(summarise_flows(assign_flows(packets_df(spark, rows)))).collect()
    assert flow.flow_id == "10.0.0.1:54321-10.0.0.2:443-6"
    assert (flow.total_packets, flow.fwd_packets, flow.bwd_packets) == (5, 3, 2)
    assert (flow.total_bytes, flow.fwd_bytes, flow.bwd_bytes) == (712, 612, 100)
    assert abs(flow.duration_s - 3.02) < 1e-9
    assert flow.fwd_tcp_flags == 2 | 16 | 17 and flow.bwd_tcp_flags == 18 | 16


@pytest.mark.parametrize("chunk_rows", [10_000, 5])
def test_gaps_per_direction(spark, chunk_rows):
    rows = random_rows(5, 300, keys=2, gap_s=10)
    want, last = {}, {}
    flows = reference_flows(rows)
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        key, no, fwd = flows[r[0]]
        prev, same = last.get((key, no)), last.get((key, no, fwd))
        gap = None if same is None else r[1] - same
        want[r[0]] = (None if prev is None else r[1] - prev, gap if fwd else None, None if fwd else gap)
        last[(key, no)] = last[(key, no, fwd)] = r[1]
    df = side_gaps(assign_flows(packets_df(spark, rows), FlowRules(chunk_rows=chunk_rows)))
    assert {r.packet_seq: (r.iat_us, r.iat_fwd_us, r.iat_bwd_us) for r in df.collect()} == want


@pytest.mark.parametrize("block,chunk_rows", [(1, 10_000), (3, 10_000), (2, 9)])
def test_folded_blocks_of_events_equal_state_machine(spark, monkeypatch, block, chunk_rows):
    monkeypatch.setattr(teardown, "BLOCK", block)
    rows = random_rows(17, 400, keys=2, gap_s=30)
    assert assigned(spark, rows, chunk_rows=chunk_rows) == reference_flows(rows)


def test_teardown_stays_in_the_engine(spark):
    keyed = with_flow_key(packets_df(spark, random_rows(3, 50))).selectExpr("*", "120000000L AS idle_us", "0 AS entry")
    plan = teardown.closings(keyed, FLOW_KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
