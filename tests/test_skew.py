import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import labels as LA
from tidewire.operators import metrics as M
from tidewire.operators import prepare as PR
from tidewire.operators import skew
from tidewire.operators import split as SP


def pairs(spark, rows):
    return spark.createDataFrame(rows, "a bigint, b bigint, x string")


@pytest.mark.parametrize("few", [50_000, 3])
@pytest.mark.parametrize("k", [0, 1, 17, 150, 299, 300, 400])
def test_first_k_equals_sort(spark, monkeypatch, k, few):
    rng = random.Random(k)
    rows = [(rng.randrange(-5, 5), rng.randrange(1 << 60), str(i)) for i in range(300)]
    real = skew.order_threshold
    monkeypatch.setattr(skew, "order_threshold", lambda *a, **kw: real(*a, **kw, bins=16, few=few))
    marked = skew.mark_first(pairs(spark, rows), ["a", "b"], k, "first", {"b": skew.HASH_RANGE})
    got = {r.x for r in marked.filter("first").collect()}
    assert got == {x for _, _, x in sorted(rows)[:k]} and marked.count() == 300


@pytest.mark.parametrize("k", [1, 30, 60, 99])
def test_copies_that_straddle_the_cut(spark, k):
    """A third of all rows are full copies of one row; exactly k rows are taken, none is lost."""
    rows = [(5, 7, "copy")] * 33 + [(i % 10, 7 if i % 10 == 5 else i, f"r{i}") for i in range(67)]
    marked = skew.mark_first(pairs(spark, rows), ["a", "b"], k, "first").collect()
    assert sorted((r.a, r.b, r.x) for r in marked) == sorted(rows)
    first = [(r.a, r.b) for r in marked if r["first"]]
    assert sorted(first) == [r[:2] for r in sorted(rows)][:k]


def test_last_label_counts(spark):
    flows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "flow_id string, flow_seq int")
    labels = spark.createDataFrame([("a", 0, 0), ("b", 1, 1), ("a", 1, 2)], "flow_id string, label bigint, row_no bigint")
    assert sorted(map(tuple, LA.label_join(flows, labels).collect())) == [("a", 1, 1), ("a", 2, 1), ("b", 1, 1)]
    assert [tuple(r) for r in LA.unmatched_flows(flows, labels).collect()] == [("c", 1)]


@pytest.mark.parametrize("small", [10**6, 1])
def test_ranking_metrics_equal_definition(spark, small):
    rng = random.Random(1)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(2000)]
    df = spark.createDataFrame([(y, min(1.0, p + 0.2 * y)) for y, p in rows], "label bigint, proba_c2 double")
    data = [tuple(r) for r in df.collect()]
    pos = [p for y, p in data if y == 1]
    neg = [p for y, p in data if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap = last = 0.0
    for t in sorted({p for _, p in data}, reverse=True):
        tp, all_ = sum(p >= t for p in pos), sum(p >= t for _, p in data)
        ap += (tp / len(pos) - last) * tp / all_
        last = tp / len(pos)
    curve = M.score_curve(df, bins=16, small=small)
    assert curve.count() == len({p for _, p in data})
    import tidewire.operators.metrics as module
    old = module.curve_of
    module.curve_of = lambda s: old(s, 16, small)
    try:
        m = M.ranking_metrics(df).first()
    finally:
        module.curve_of = old
    assert m.pr_auc == pytest.approx(ap) and m.roc_auc == pytest.approx(auc)


def test_metrics_without_one_class(spark):
    m = M.evaluate(spark.createDataFrame([(0, 0.2), (0, 0.7)], "label bigint, proba_c2 double")).first()
    assert (m.pr_auc, m.roc_auc, m.mcc, m.precision, m.recall) == (0, 0, 0, 0, 0)
    assert m.fpr == 0.5 and m.balanced_accuracy == 0.5


def test_benign_sample_sizes(spark):
    t = spark.createDataFrame([(i, int(i % 4 == 0), float(i)) for i in range(400)], "row_id int, label bigint, start_time double")
    for n, want in ((50, 50), (300, 300), (1000, 300), (0, 0)):
        s = PR.benign_sample(t, n, row_key=["row_id"])
        assert s.filter("label = 0").count() == want and s.filter("label = 1").count() == 100
    a, b = (PR.benign_sample(t, 50, seed, ["row_id"]).filter("label = 0").select("row_id").collect() for seed in (1, 2))
    assert a != b


def test_splits(spark, caplog):
    t = spark.createDataFrame([(i, int(i % 5 == 0), float(i // 3)) for i in range(202)], "row_id int, label bigint, start_time double")
    by_time = SP.time_split(t, 0.25, ["row_id"])
    assert by_time.filter("is_test").count() == 202 - int(202 * 0.75) and by_time.count() == 202
    assert by_time.filter("not is_test").agg(F.max("start_time")).first()[0] <= by_time.filter("is_test").agg(F.min("start_time")).first()[0]
    counts = {(r.label, r.is_test): r["count"] for r in SP.random_split(t, 0.25, 1, ["row_id"]).groupBy("label", "is_test").count().collect()}
    assert counts == {(0, False): 120, (0, True): 41, (1, False): 31, (1, True): 10}
    with caplog.at_level("WARNING"):
        flat = SP.time_split(t.withColumn("start_time", F.lit(0.0)), 0.25, ["row_id"])
    assert "does not vary" in caplog.text and flat.filter("is_test").count() == 51
    assert SP.train_quotas({0: 161, 1: 41}, 0.25) == {0: 120, 1: 31}    # 120.35 and 30.65 of 151
