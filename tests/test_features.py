import math
from collections import Counter

import pytest
from helpers import packet, packets_df, reference_flows
from test_flows import random_rows

from tidewire.operators.features import flow_features
from tidewire.operators.flows import FlowRules
from tidewire.schemas import FEATURE_NAMES


def entropy(data):
    n = len(data)
    return -sum(c / n * math.log2(c / n) for c in Counter(data).values()) if n else 0.0


def features(spark, rows, **rules):
    return [r.features.asDict() for r in flow_features(packets_df(spark, rows), FlowRules(**rules)).collect()]


def close(value, want, tol=1e-5):
    assert abs(value - want) <= tol * max(1.0, abs(want)), (value, want)


def test_tcp_conversation(spark):
    a, b, t = ("10.0.0.1", 54321), ("10.0.0.2", 443), 1_000_000_000_000
    text = b"GET / HTTP/1.1\r\nHost: c2.com\r\n\r\n"
    rows = [
        packet(0, t, a, b, flags=2, length=60), packet(1, t + 50_000, b, a, flags=18, length=60),
        packet(2, t + 100_000, a, b, flags=16, length=512, payload_len=452, payload=text),
        packet(3, t + 3_000_000, a, b, flags=17, length=40), packet(4, t + 3_020_000, b, a, flags=16, length=40),
    ]
    f, = features(spark, rows)
    assert list(f) == FEATURE_NAMES
    want = dict(
        total_packets=5, fwd_packet_count=3, bwd_packet_count=2, total_bytes=712, fwd_total_bytes=612,
        bwd_total_bytes=100, fwd_bwd_byte_ratio=0.859551, direction_dominance=0.859551, pkt_len_mean=142.4,
        pkt_len_std=185.016324, pkt_len_min=40, pkt_len_max=512, small_pkt_ratio=0.8, fwd_payload_bytes=452,
        iat_mean=0.755, iat_std=1.238477, iat_skew=1.154361, iat_kurtosis=-0.666926, beacon_score=1.640367,
        pkts_per_second=1.655629, bytes_per_second=235.761589, active_time=0.12, header_entropy=2.321928,
        dns_query_entropy=0, avg_payload_size=150.666667, fwd_syn_flag=1, fwd_fin_flag=1, rst_flag=0,
        payload_entropy=entropy(text), protocol=6, dst_port=443,
    )
    for name, value in want.items():
        close(f[name], value)


@pytest.mark.parametrize("chunk_rows", [100, 3, 1])
def test_beacon(spark, chunk_rows):
    a, b = ("10.0.0.1", 54321), ("93.184.216.34", 443)
    rows = [
        packet(i, 10**12 + i * 60_010_000, *((a, b) if i % 2 == 0 else (b, a)), length=128, payload_len=88,
               payload=bytes(range(88)))
        for i in range(10)
    ]
    f, = features(spark, rows, chunk_rows=chunk_rows)
    want = dict(flow_duration=540.09, total_bytes=1280, fwd_payload_bytes=440, iat_mean=60.01, iat_std=0,
                beacon_score=0, payload_entropy=6.459432, avg_payload_size=88, pkts_per_second=0.018515,
                bytes_per_second=2.369975, iat_skew=0, iat_kurtosis=0, active_time=540.09)
    for name, value in want.items():
        close(f[name], value)


@pytest.mark.parametrize("chunk_rows", [10_000, 6, 1])
def test_payload_entropy_and_active_time(spark, chunk_rows):
    import random
    rng = random.Random(3)
    rows = []
    for r in random_rows(8, 300, keys=4, gap_s=15):
        r = list(r)
        if r[6] == 17:                                   # some DNS
            r[4], r[5] = (53, r[5]) if r[4] < r[5] else (r[4], 53)
        r[10] = bytearray(rng.choices(b"abcdefgh\x00\xff", k=rng.choice([0, 0, 3, 5, 40])))
        rows.append(tuple(r))
    flows = reference_flows(rows)
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        key, no, fwd = flows[r[0]]
        groups.setdefault((key, no), []).append((r, fwd))
    want = {}
    for (key, no), packets in groups.items():
        if len(packets) < 2:
            continue
        data = b"".join(bytes(r[10]) for r, fwd in packets if fwd)
        dns = data[12:] if len(data) > 12 else data
        gaps = [b[0][1] - a[0][1] for a, b in zip(packets, packets[1:])]
        active = sum(g for g in gaps if g * len(gaps) <= sum(gaps)) / 1e6
        want[(key, no)] = (entropy(data), entropy(dns) if 53 in (key[1], key[3]) else 0.0, active)
    df = flow_features(packets_df(spark, rows), FlowRules(chunk_rows=chunk_rows))
    got = {
        ((r.lo_ip, r.lo_port, r.hi_ip, r.hi_port, r.protocol), r.flow_seq):
            (r.features.payload_entropy, r.features.dns_query_entropy, r.features.active_time)
        for r in df.collect()
    }
    assert got.keys() == want.keys()
    assert any(w[1] > 0 for w in want.values())
    for k in want:
        for g, w in zip(got[k], want[k]):
            close(g, w)
