"""A plain state machine to check flow assignment against, and small packet tables."""

from tidewire.schemas import PACKETS


def packet(seq, ts_us, src=("10.0.0.1", 54321), dst=("10.0.0.2", 443), proto=6, flags=16, length=60,
           payload_len=0, payload=b""):
    return (seq, ts_us, src[0], dst[0], src[1], dst[1], proto, length, payload_len, flags, bytearray(payload))


def packets_df(spark, rows):
    return spark.createDataFrame(rows, PACKETS)


def reference_flows(rows, tcp_us=120_000_000, other_us=60_000_000):
    """{packet_seq: (key, flow_seq, is_fwd)}, one packet after the other."""
    live, counts, out = {}, {}, {}
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        seq, ts, sip, dip, sport, dport, proto, _, _, flags, _ = row
        a, b = (sip, sport), (dip, dport)
        key = (*min(a, b), *max(a, b), proto)
        limit = tcp_us if proto == 6 else other_us
        flow = live.get(key)
        if flow is not None and ts - flow["seen"] > limit:
            flow = None
        if flow is None:
            counts[key] = counts.get(key, 0) + 1
            live[key] = {"seen": ts, "fin": False, "src": a, "no": counts[key]}
            out[seq] = (key, counts[key], True)
            continue
        flow["seen"] = ts
        out[seq] = (key, flow["no"], a == flow["src"])
        if proto == 6:
            if flow["fin"] and flags & 16 and not flags & 2:
                live[key] = None
            elif flags & 4:
                live[key] = None
            elif flags & 1:
                flow["fin"] = True
    return out
