"""Long payloads travel as counts of their bytes."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from helpers import packet, packets_df, reference_flows
from pyspark.sql import functions as F

from tidewire.operators.entropy import TALLY_BYTES, pairs_of, tallied
from tidewire.operators.features import flow_features
from tidewire.operators.flows import FlowRules


def entropy(data):
    n = len(data)
    return -sum(c / n * math.log2(c / n) for c in Counter(data).values()) if n else 0.0


def long_rows():
    """Long and short payloads by turns, some DNS, and one byte more often than a pair holds."""
    rng = random.Random(5)
    a, b = ("10.0.0.1", 54321), ("10.0.0.2", 53)
    return [
        packet(i, 10**12 + i * 1_000_000 + (i // 40) * 10**9, *((b, a) if i % 3 == 2 else (a, b)), proto=17,
               payload=b"\xff" * 700 if i % 11 == 0 else bytes(rng.choices(
                   b"abcdefgh \x00\xff", k=rng.choice([0, 1, 5, 12, TALLY_BYTES, TALLY_BYTES + 1, 3000]))))
        for i in range(160)
    ]


def test_pairs_hold_every_byte():
    rows = [None, b"", b"\x00" * 1000, bytes(range(256)), b"ab" * 255, None, b"x"]
    for array in (pa.array(rows, pa.binary()), pa.array([b"zz"] + rows, pa.binary()).slice(1)):
        for row, pairs in zip(rows, pairs_of(array).to_pylist(), strict=True):
            got = Counter()
            for byte, times in zip(pairs[::2], pairs[1::2], strict=True):
                got[byte] += times
            assert got == Counter(row or b"")


@pytest.mark.parametrize("chunk_rows", [10_000, 7, 1])
def test_entropies_of_long_payloads(spark, chunk_rows):
    rows = long_rows()
    flows = reference_flows(rows)
    texts = {}
    for r in rows:
        key, no, fwd = flows[r[0]]
        texts[no] = texts.get(no, b"") + (bytes(r[10]) if fwd else b"")
    assert len(texts) == 4
    df = flow_features(packets_df(spark, rows), FlowRules(chunk_rows=chunk_rows))
    got = {r.flow_seq: (r.features.payload_entropy, r.features.dns_query_entropy) for r in df.collect()}
    assert got == {no: pytest.approx((entropy(t), entropy(t[12:])), rel=1e-5) for no, t in texts.items()}


def test_long_payloads_are_counted_before_they_move(spark):
    packets = packets_df(spark, long_rows())
    size = F.octet_length("payload")
    most, total = tallied(packets).agg(F.max(size), F.sum(size + F.coalesce(F.octet_length("tally"), F.lit(0)))).first()
    assert most <= TALLY_BYTES and total < packets.agg(F.sum(size)).first()[0] / 10
    plan = flow_features(packets, groups=("entropy",))._jdf.queryExecution().sparkPlan().toString().splitlines()
    counted = next(line for line in plan if "ArrowEvalPython" in line)
    assert plan.index(counted) > next(i for i, line in enumerate(plan) if "MapInArrow" in line)
    assert all("payload" not in line for line in plan if "Window" in line and "tally" not in line)
