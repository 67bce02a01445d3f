"""What a stream remembers of a conversation: sums that add up, never packets that have been counted.

An open flow is one row of counts, unions, extremes, central moments of its gaps and a histogram of its forward bytes; rows of
later packets are merged into it with array operations. Packets the watermark has not passed wait in buckets of time, as fixed
records with the multiset of their payload bytes and its first twelve; payloads themselves never enter the state.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, fields as fields_of

import numpy as np

from tidewire.schemas import ACK, DNS_HEADER_BYTES, FIN, RST, SMALL_PAYLOAD, SYN

#: Gaps kept one by one for `active_time`; a longer flow keeps sums by size of gap, 16 sizes an octave, and says so.
MAX_GAPS = 1_000_000
SIZES = 16

WAITING = np.dtype([("ts", "<i8"), ("seq", "<i8"), ("length", "<i4"), ("payload_len", "<i4"), ("flags", "<i4"), ("lo", "u1"), ("head", "u1"), ("bytes", "<u4")])


def byte_multiset(payload: bytes) -> bytes:
    """The bytes of a payload without their order: sorted, or as pairs of value and count where that is shorter."""
    data = np.frombuffer(payload, np.uint8)
    counts = np.bincount(data, minlength=256)
    used = np.flatnonzero(counts)
    if 5 * len(used) < len(data):
        return b"\1" + used.astype(np.uint8).tobytes() + counts[used].astype("<u4").tobytes()
    return b"\0" + np.sort(data).tobytes()


def add_bytes(counts: np.ndarray, packed: bytes) -> None:
    if packed[:1] == b"\1":
        n = (len(packed) - 1) // 5
        counts[np.frombuffer(packed, np.uint8, n, 1)] += np.frombuffer(packed, "<u4", n, 1 + n)
    else:
        counts += np.bincount(np.frombuffer(packed, np.uint8, offset=1), minlength=256)


@dataclass
class Rows:
    """Packets in order of time: columns, and per packet its first payload bytes and their multiset (empty without payload)."""

    at: np.ndarray
    heads: list[bytes]
    bytes: list[bytes]

    def take(self, where: np.ndarray) -> "Rows":
        return Rows(self.at[where], [self.heads[i] for i in where.tolist()], [self.bytes[i] for i in where.tolist()])

    def in_order(self) -> "Rows":
        return self.take(np.lexsort((self.at["seq"], self.at["ts"])))

    def size(self) -> int:
        return self.at.nbytes + int(self.at["head"].sum()) + int(self.at["bytes"].sum())

    @staticmethod
    def joined(parts: "list[Rows]") -> "Rows":
        if len(parts) == 1:
            return parts[0]
        return Rows(np.concatenate([p.at for p in parts]), [h for p in parts for h in p.heads], [b for p in parts for b in p.bytes])

    def packed(self) -> tuple[bytes, bytes]:
        return self.at.tobytes(), b"".join(x for pair in zip(self.heads, self.bytes) for x in pair)

    @staticmethod
    def unpacked(at: bytes, data: bytes) -> "Rows":
        rows = np.frombuffer(at, WAITING)
        ends = np.cumsum(np.stack([rows["head"], rows["bytes"]], 1).astype(np.int64).ravel()).tolist()
        cuts = [data[a:b] for a, b in zip([0, *ends], ends)]
        return Rows(rows, cuts[::2], cuts[1::2])

    @staticmethod
    def of(frame) -> "Rows":
        """From a pandas table with the columns of a packet."""
        payloads = [bytes(p) if p is not None and len(p) else b"" for p in frame["payload"]]
        heads, multisets = [p[:DNS_HEADER_BYTES] for p in payloads], [byte_multiset(p) if p else b"" for p in payloads]
        at = np.zeros(len(frame), WAITING)
        for name, column in (("ts", "ts_us"), ("seq", "packet_seq"), ("length", "length"), ("payload_len", "payload_len"), ("flags", "tcp_flags"), ("lo", "from_lo")):
            at[name] = frame[column].fillna(0).to_numpy().astype(WAITING[name])
        at["head"], at["bytes"] = list(map(len, heads)), list(map(len, multisets))
        return Rows(at, heads, multisets)


def closings(ts: np.ndarray, flags: np.ndarray, idle: np.ndarray, is_open: bool, fin: bool) -> tuple[np.ndarray, bool]:
    """(which packets close a flow by teardown, whether a FIN is still unanswered after the last one).

    `idle` marks the packets that follow an idle gap. Only packets with FIN or RST are looked at one by one.
    """
    n = len(ts)
    closes = np.zeros(n, bool)
    acks = np.where((flags & ACK > 0) & (flags & SYN == 0), np.arange(n), n)
    after = np.append(np.minimum.accumulate(acks[::-1])[::-1], n)            # the first ACK at or after a place
    events = np.flatnonzero(flags & (FIN | RST))
    starts = np.flatnonzero(idle)
    if not n or not len(starts) or starts[0] > 0:
        starts = np.concatenate([[0], starts])
    ends = [*starts[1:].tolist(), n]
    low = np.searchsorted(events, starts).tolist()
    waiting = False
    for k, (a, b) in enumerate(zip(starts.tolist(), ends)):
        goes_on = a == 0 and is_open and not (n and idle[0])
        opened = a - 1 if goes_on else a
        pending = int(after[a]) if goes_on and fin else None               # b or beyond: not answered in this run
        for e in events[low[k]:(low[k + 1] if k + 1 < len(low) else len(events))].tolist():
            if pending is not None and pending < e:
                closes[pending] = True
                opened, pending = pending + 1, None
            if e == opened:
                continue
            if pending == e or flags[e] & RST:
                closes[e] = True
                opened, pending = e + 1, None
            elif pending is None:
                pending = int(after[e + 1])
        if pending is not None and pending < b:
            closes[pending] = True
            pending = None
        waiting = pending is not None
    return closes, waiting


def moments(x: np.ndarray) -> tuple[int, float, float, float, float]:
    """(n, mean, and sums of the second, third and fourth powers of deviations)."""
    if not len(x):
        return 0, 0.0, 0.0, 0.0, 0.0
    mean = int(x.sum()) / len(x)
    d = x - mean
    d2 = d * d
    return len(x), mean, float(d2.sum()), float((d2 * d).sum()), float((d2 * d2).sum())


def merged(a: tuple, b: tuple) -> tuple[int, float, float, float, float]:
    """Moments of two sets of values together."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    (p, mean, s2, s3, s4), (q, other, t2, t3, t4) = a, b
    n, d = p + q, other - mean
    r = d / n
    return (n, mean + q * r, s2 + t2 + d * r * p * q,
            s3 + t3 + d * r * r * p * q * (p - q) + 3 * r * (p * t2 - q * s2),
            s4 + t4 + d * r * r * r * p * q * (p * p - p * q + q * q) + 6 * r * r * (p * p * t2 + q * q * s2) + 4 * r * (p * t3 - q * s3))


@dataclass
class FlowState:
    """An open flow. Two parts of one flow add up by `add`; `summary` is what the batch plan's aggregate holds."""

    flow_seq: int
    start_us: int
    last_us: int
    fwd_lo: bool
    fin: bool = False
    total_packets: int = 0
    fwd_packets: int = 0
    fwd_bytes: int = 0
    bwd_bytes: int = 0
    fwd_payload_bytes: int = 0
    bwd_payload_bytes: int = 0
    fwd_tcp_flags: int = 0
    bwd_tcp_flags: int = 0
    len_squares: int = 0
    len_min: int = 0
    len_max: int = 0
    n_small: int = 0
    gap_sum: int = 0
    gap_min: int = 0
    gap_max: int = 0
    n_gaps: int = 0
    gap_mean: float = 0.0
    gap_m2: float = 0.0
    gap_m3: float = 0.0
    gap_m4: float = 0.0
    head: bytes = b""
    byte_counts: bytes = b""
    gap_sizes: bytes = b""
    listed: bool = False

    def add(self, rows: Rows, fwd: np.ndarray, gaps: np.ndarray) -> None:
        """Later packets of the flow, with the gaps before them (the packet that opened it has none)."""
        at = rows.at
        length, payload, flags = at["length"].astype(np.int64), at["payload_len"].astype(np.int64), at["flags"]
        self.len_min = int(length.min()) if not self.total_packets else min(self.len_min, int(length.min()))
        self.len_max = int(length.max()) if not self.total_packets else max(self.len_max, int(length.max()))
        self.total_packets += len(at)
        self.fwd_packets += int(fwd.sum())
        for side, where in (("fwd", fwd), ("bwd", ~fwd)):
            self.__dict__[f"{side}_bytes"] += int(length[where].sum())
            self.__dict__[f"{side}_payload_bytes"] += int(payload[where].sum())
            self.__dict__[f"{side}_tcp_flags"] |= int(np.bitwise_or.reduce(flags[where], initial=0))
        self.len_squares += int((length * length).sum())
        self.n_small += int((payload < SMALL_PAYLOAD).sum())
        if len(gaps):
            self.gap_min = int(gaps.min()) if not self.n_gaps else min(self.gap_min, int(gaps.min()))
            self.gap_max = max(self.gap_max, int(gaps.max()))
            self.gap_sum += int(gaps.sum())
            got = merged((self.n_gaps, self.gap_mean, self.gap_m2, self.gap_m3, self.gap_m4), moments(gaps))
            self.n_gaps, self.gap_mean, self.gap_m2, self.gap_m3, self.gap_m4 = got
        self.last_us = int(at["ts"][-1])
        with_payload = [i for i in np.flatnonzero(fwd).tolist() if rows.bytes[i]]
        if with_payload:
            counts = np.frombuffer(self.byte_counts, np.int64).copy() if self.byte_counts else np.zeros(256, np.int64)
            for i in with_payload:
                add_bytes(counts, rows.bytes[i])
                if len(self.head) < DNS_HEADER_BYTES:
                    self.head = (self.head + rows.heads[i])[:DNS_HEADER_BYTES]
            self.byte_counts = counts.tobytes()

    def add_sizes(self, gaps: np.ndarray) -> None:
        """Gaps by their size, for flows too long to keep them one by one."""
        table = np.frombuffer(self.gap_sizes, np.int64).reshape(2, -1).copy() if self.gap_sizes else np.zeros((2, 64 * SIZES), np.int64)
        size = np.minimum(np.where(gaps > 0, np.log2(np.maximum(gaps, 1)) * SIZES + 1, 0).astype(np.int64), table.shape[1] - 1)
        np.add.at(table[0], size, 1)
        np.add.at(table[1], size, gaps)
        self.gap_sizes = table.tobytes()

    def active_us(self, gaps: Iterable[np.ndarray]) -> int:
        """The sum of the gaps that are no longer than the mean gap."""
        if not self.n_gaps:
            return 0
        limit = self.gap_sum // self.n_gaps
        if not self.gap_sizes:
            return sum(int(g[g <= limit].sum()) for g in gaps)
        n, total = np.frombuffer(self.gap_sizes, np.int64).reshape(2, -1)
        mean = np.where(n > 0, total / np.maximum(n, 1), np.inf)           # a size is in or out as a whole, by its mean
        return int(total[mean <= limit].sum())

    def summary(self, gaps: Iterable[np.ndarray]) -> tuple:
        """The values of `SUMMARY`."""
        n, total = self.total_packets, self.fwd_bytes + self.bwd_bytes
        counts = np.frombuffer(self.byte_counts, np.int64) if self.byte_counts else np.zeros(256, np.int64)
        rest = counts - np.bincount(np.frombuffer(self.head, np.uint8), minlength=256) if counts.sum() > DNS_HEADER_BYTES else counts
        spread = self.gap_m2 > 0
        g = self.n_gaps
        return (self.fwd_lo, self.start_us, self.last_us, n, self.fwd_packets, n - self.fwd_packets, total, self.fwd_bytes, self.bwd_bytes, self.fwd_payload_bytes,
                self.bwd_payload_bytes, self.fwd_tcp_flags, self.bwd_tcp_flags, total / n, math.sqrt(max(n * self.len_squares - total * total, 0)) / n, self.len_min,
                self.len_max, self.n_small, g, self.gap_mean if g else None, math.sqrt(self.gap_m2 / g) if g else None, self.gap_min if g else None,
                self.gap_max if g else None, math.sqrt(g) * self.gap_m3 / self.gap_m2 ** 1.5 if spread else None, g * self.gap_m4 / self.gap_m2 ** 2 - 3 if spread else None,
                self.active_us(gaps), self.gap_sum, bool(self.gap_sizes), entropy(counts), entropy(rest))


def entropy(counts: np.ndarray) -> float:
    """Bits a byte."""
    used = counts[counts > 0].astype(float)
    n = used.sum()
    return max(float(np.log2(n) - (used * np.log2(used)).sum() / n), 0.0) if n else 0.0


SUMMARY = ("fwd_lo boolean, start_us bigint, end_us bigint, total_packets bigint, fwd_packets bigint, bwd_packets bigint, total_bytes bigint, "
           "fwd_bytes bigint, bwd_bytes bigint, fwd_payload_bytes bigint, bwd_payload_bytes bigint, fwd_tcp_flags int, bwd_tcp_flags int, "
           "len_mean double, len_std double, len_min int, len_max int, n_small bigint, n_gaps bigint, gap_mean double, gap_std double, "
           "gap_min bigint, gap_max bigint, gap_skew double, gap_kurt double, active_us bigint, gap_sum bigint, gaps_rounded boolean, "
           "payload_entropy double, dns_query_entropy double")
#: The columns of a stored `FlowState`, in its order, the timer that is set, waiting packets while they are few, and the buckets in which many wait.
STATE = ", ".join(f"{f.name} " + {"int": "bigint", "bool": "boolean", "float": "double", "bytes": "binary"}[f.type] for f in fields_of(FlowState)) + ", timer bigint, at binary, data binary, buckets binary"
