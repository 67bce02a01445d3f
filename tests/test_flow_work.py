"""Work that the flow features of many short flows must not do twice, or row by row in lambdas."""

import math
import random
from collections import Counter

import pytest
from helpers import packet, packets_df
from pyspark.sql import functions as F

from tidewire.functions.packets import with_flow_key
from tidewire.functions.scalar import header_entropy
from tidewire.operators import skew
from tidewire.operators.features import flow_features


def entropy(values):
    n = len(values)
    return -sum(c / n * math.log2(c / n) for c in Counter(values).values()) if n else 0.0


def test_header_entropy_has_no_lambdas(spark):
    rng = random.Random(2)
    few = [None, 0, 1, 257, 256, 65535, 443, 70000]
    rows = [(rng.choice(few), rng.choice(few), rng.choice([None, 0, 1, 6, 255])) for _ in range(400)]
    df = spark.createDataFrame(rows, "a int, b int, p int").select(
        "*", header_entropy(F.col("a"), F.col("b"), F.col("p")).alias("h"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    for a, b, p, h in df.collect():
        bytes_ = [x for port in (a, b) if port is not None for x in (port & 255, port >> 8 & 255)]
        assert h == pytest.approx(entropy(bytes_ + ([] if p is None else [p & 255])), abs=1e-12), (a, b, p)


def test_closings_are_worked_out_once(spark):
    rows = [packet(i, 10**12 + i * 1000, flags=[2, 16, 17, 16][i % 4], payload=b"abc") for i in range(40)]
    df = flow_features(packets_df(spark, rows), long_payloads=False)
    assert len(df.collect()) == 10
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Generate explode") == 1


def test_only_heavy_conversations_are_cut(spark):
    many = [packet(i, 10**12 + i, src=("10.0.0.1", 1000 + i % 50)) for i in range(200)]
    assert skew.plan_cuts(with_flow_key(packets_df(spark, many)), chunk_rows=50) is None
    heavy = many + [packet(1000 + i, 10**12 + i, src=("10.0.0.9", 9)) for i in range(120)]
    cuts = skew.plan_cuts(with_flow_key(packets_df(spark, heavy)), chunk_rows=50)
    row, = cuts.table.collect()
    assert row.lo_port == 443 or row.hi_port == 443
    assert "10.0.0.9" in (row.lo_ip, row.hi_ip) and len(row.cuts) == 2 == cuts.most


@pytest.mark.parametrize("min_packets", [1, 2])
def test_lone_packets_are_not_counted_where_no_flow_has_them(spark, min_packets):
    """Flows of 1, 2, 1 and 3 packets in one conversation: a flow of one is told from a flow that goes on."""
    times = [0, 200, 201, 400, 600, 601, 602]
    rows = [packet(i, 10**12 + t * 10**6, proto=17, payload=bytes(range(i + 2))) for i, t in enumerate(times)]
    df = flow_features(packets_df(spark, rows), min_packets=min_packets)
    got = {r.flow_seq: r.features.payload_entropy for r in df.collect()}
    texts = {1: rows[0:1], 2: rows[1:3], 3: rows[3:4], 4: rows[4:7]}
    want = {no: entropy(b"".join(bytes(r[10]) for r in t)) for no, t in texts.items() if len(t) >= min_packets}
    assert got == {no: pytest.approx(h, rel=1e-5) for no, h in want.items()}
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert ("_lone" in final or "lead(starts" in final) == (min_packets > 1)
