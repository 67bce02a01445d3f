import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import hard_negatives as HN

SCHEMA = "vec_id long, embedding array<float>, label int"

def brute(rows, step=10):
    kept = [(k, [math.floor(256 * float(np.float32(x))) for x in v], lab) for k, v, lab in rows
            if lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for i, (a, v, lab) in enumerate(kept):
        if a is None or a % step:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), k is None, k or 0, j, lab2 == lab) for j, (k, w, lab2) in enumerate(kept) if j != i))
        good = [s for s in scored if s[4]][:5]
        for p in good:
            bad = [s for s in scored if not s[4] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            out.update((a, kept[p[3]][0], r, kept[s[3]][0], -p[0], -s[0]) for r, s in enumerate(bad, 1))
    return out


def got(df, **kw):
    return Counter(map(tuple, HN.hard_negatives(df, F.col("vec_id") % 10 == 0, **kw).collect()))


@pytest.mark.parametrize("kw", [{}, {"leaf_rows": 20, "sample": 200}, {"leaf_rows": 30, "block_rows": 7, "sample": 60}])
def test_equals_brute_force(spark, kw):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 12))
    rows = [(i, (centres[rng.integers(6)] + rng.standard_normal(12) * 0.4).tolist(), int(rng.integers(3))) for i in range(400)]
    want = brute(rows)
    assert len(want) > 200 and got(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw) == want


def test_awkward_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, np.round(rng.standard_normal(8), 1).tolist(), int(rng.integers(3))) for i in range(120)]
    rows += [(10, rows[10][1], rows[10][2]), (20, rows[3][1], 1), (None, rows[0][1], 1), (None, rows[0][1], 2)] + [rows[30]] * 2
    rows += [(500, None, 1), (510, [], 1), (520, [None] * 8, 1), (530, [float("nan")] * 8, 2), (540, [float("inf")] * 8, 2), (550, [1.0] * 8, None), (560, [0.0] * 8, 1), (570, [2.0] * 8, 77)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS row", "2 AS block", "'k' AS key", "3 AS q", "4 AS score", "5 AS anchor", "6 AS leaf")
    for kw in ({}, {"leaf_rows": 10, "sample": 100, "block_rows": 5}):
        # ties between rows of one key are settled by the order they were read, so one partition here
        assert got(df.coalesce(1), **kw) == brute(rows)
    assert got(df.limit(0)) == Counter() and got(df.where("vec_id IN (500, 550)")) == Counter() and got(df.where("vec_id = 560")) == Counter()


def test_one_vector_and_one_label_hold_most_rows(spark):
    rows = [(i, [0.5, 0.25, 0.0, 1.0], 0) for i in range(300)] + [(300 + i, [0.5, 0.25, 0.01 * i, 0.9], i % 2) for i in range(40)]
    assert got(spark.createDataFrame(rows, SCHEMA).coalesce(1), leaf_rows=20, block_rows=16, sample=100) == brute(rows)


def test_search_drops_leaves_but_never_a_hit():
    rng = np.random.default_rng(9)
    x = (rng.standard_normal((20, 6))[rng.integers(0, 20, 3000)] * 800 + rng.standard_normal((3000, 6)) * 40).astype(np.int64)
    root, leaves, nodes = HN.grow(x[:800], 60)
    norms = (x ** 2).sum(1)
    for node in nodes:
        k = len(node.points)
        node.low, node.high, node.norm_low, node.norm_high = np.full((k, k), np.inf), np.full((k, k), -np.inf), np.full(k, np.inf), np.full(k, -np.inf)

    def seen(node, rows, d, side):
        for j in np.unique(side):
            node.low[:, j], node.high[:, j] = np.sqrt(d[side == j].min(0)), np.sqrt(d[side == j].max(0))
            node.norm_low[j], node.norm_high[j] = norms[rows[side == j]].min(), norms[rows[side == j]].max()

    leaf = HN.route(x, root, seen)
    assert leaves > 20 and len(np.unique(leaf)) > 20
    q = x[:200]
    best = np.sort(q @ x.T, 1)[:, -20:]
    low, high = best[:, :1].astype(float), best[:, -3:-2].astype(float)
    alive = HN.surviving(q, (q ** 2).sum(1).astype(float), low, high, root, leaves)
    hits = (q @ x.T >= low) & (q @ x.T <= high)
    assert all(alive[i, leaf[j]] for i, j in zip(*np.nonzero(hits)))
    assert alive.mean() < 0.5
    none = HN.surviving(q, (q ** 2).sum(1).astype(float), np.ones((200, 1)), np.zeros((200, 1)), root, leaves)
    assert not none.any()
