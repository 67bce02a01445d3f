import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewire.llm import vector_codes as VC

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(k, [math.floor(4096 * float(np.float32(x))) for x in v], lab) for k, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    d = len(kept[0][1]) // parts
    cut = [[v[p * d:(p + 1) * d] for p in range(parts)] for _, v, _ in kept]
    start = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in start] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for x in cut:
                held[near(p, x[p])[1]].append(x[p])
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[near(p, x[p]) for p in range(parts)] for x in cut]
    errors = [sum(f[0] for f in fs) for fs in found]
    sums = Counter()
    for (_, _, lab), e in zip(kept, errors):
        sums[lab] += e
    return sorted(map(str, ((k, "".join(f"{f[1]:02x}" for f in fs), e, sums[lab], digest) for (k, _, lab), fs, e in zip(kept, found, errors))))


def got(df, **kw):
    return sorted(str(tuple(r)) for r in VC.vector_codes(df, **kw).collect())


@pytest.mark.parametrize("n", [1, 10, 16, 150])
def test_equals_brute_force(spark, n):
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((4, 16))
    rows = [(int(i), (centres[i % 4] + rng.standard_normal(16) * 0.3).astype(np.float32).tolist(), int(i % 3) if i % 5 else None) for i in rng.permutation(n)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), np.round(rng.standard_normal(16), 1).astype(np.float32).tolist(), 1) for i in range(30)]
    rows += [rows[4]] * 3 + [(4, rows[5][1], 2), (None, rows[6][1], None), (None, rows[6][1], 2)]
    rows += [(90, None, 1), (91, [], 1), (92, [None] + rows[0][1][1:], 1), (93, [float("nan")] * 16, 1), (94, [float("inf")] * 16, None), (95, [-float("inf")] * 16, 1)]
    rows += [(96, [0.0] * 16, 1), (97, [-0.00001] * 16, 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS code", "'k' AS key", "2 AS error", "3 AS near", "4 AS whole")
    assert got(df.repartition(3)) == brute(rows)
    assert got(df.limit(0)) == [] and VC.vector_codes(df.limit(0)).columns == VC.vector_codes(df).columns
    assert got(df.where("vec_id IN (90, 91, 93)")) == []


def test_all_vectors_alike(spark):
    rows = [(i, [0.5] * 16, 0) for i in range(60)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_many_labels_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(VC, "MOST_SENT", 0)
    rows = [(i, [float(i % 7), 1.0] * 8, i % 4 if i % 4 else None) for i in range(40)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_bounds_prune_and_never_lose_the_nearest():
    rng = np.random.default_rng(8)
    centres = rng.integers(-9000, 9000, (16, 8))
    x = centres[rng.integers(0, 16, 2000)] + rng.integers(-800, 800, (2000, 8))
    pivots = VC.pivots_of(centres, 4)
    code, best, done = VC.nearest(x, VC.distances(x, pivots), centres, pivots)
    d = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
    assert done < 2000 * 16 / 4                                         # most distances are never worked out
    tied = np.zeros((3, 8), np.int64)
    assert VC.nearest(tied, VC.distances(tied, pivots), np.stack([pivots[0], pivots[0], pivots[0]]), pivots)[0].tolist() == [0, 0, 0]


def test_refusals(spark):
    for rows in ([(1, [1.0] * 8, 0), (2, [1.0] * 16, 0)], [(1, [1.0] * 7, 0)], [(1, [1e6] * 8, 0)]):
        with pytest.raises(Exception, match="lengths|parts|too large"):
            VC.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()
