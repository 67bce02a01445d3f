import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import deep_forest as D
from tidewire.operators import model as MO
from tidewire.plans import queries_models as Q
from tidewire.schemas import FEATURE_NAMES


def rows_of(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 34))
    rows = [(*map(float, r), int(r[0] + r[1] > 0), float(i // 2), f"r{i}") for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(f"{n} float" for n in FEATURE_NAMES) + ", label bigint, start_time double, row_id string")


def test_ablation_splits_once_and_leaves_no_tables(spark, monkeypatch):
    """Each run made, moved, split and kept the table anew, and what was exchanged for it stayed on the disk."""
    split, times, folders, held = MO.time_split, [], [], []

    def counted(table, *args):
        times.append(table)
        folders.extend(os.path.dirname(f.removeprefix("file://")) for f in table.inputFiles())
        return split(table, *args)

    monkeypatch.setattr(MO, "time_split", counted)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    plain = MO.train
    monkeypatch.setattr(MO, "train", lambda *a: held.append(spark.sparkContext._jsc.getPersistentRDDs().size()) or plain(*a))
    runs = {"all": [], "blind": ["total_packets"], "other": ["dst_port", "protocol"]}
    got = MO.ablation(rows_of(spark), runs, lambda: MO.forest(trees=3, depth=3), row_key=["row_id"]).collect()
    assert [(r.run, r.zeroed, r.tn + r.fp + r.fn + r.tp) for r in got] == [(k, ",".join(v), 100) for k, v in runs.items()]
    assert len(times) == 1 and folders and held == [before] * 3
    assert not any(map(os.path.exists, folders))


def test_ablation_runs_equal_single_runs(spark):
    """One split for all runs, and each run blinds its features only."""
    table = rows_of(spark, 200)
    got = MO.ablation(table, {"all": [], "both": list(FEATURE_NAMES[:2])}, lambda: MO.forest(trees=3, depth=3), row_key=["row_id"]).collect()
    sides = MO.time_split(table, row_key=["row_id"]).groupBy("is_test").agg(F.sum("label").alias("c2"), F.count("*").alias("n")).collect()
    test = next(r for r in sides if r.is_test)
    assert all((r.tp + r.fn, r.tn + r.fp) == (test.c2, test.n - test.c2) for r in got)
    assert got[0].roc_auc > got[1].roc_auc


@pytest.fixture
def asked_for(monkeypatch):
    """The estimator a query trains."""
    got = []

    def fit(table, estimator=None, **options):
        got.append(estimator)
        raise InterruptedError

    monkeypatch.setattr(MO, "fit_and_evaluate", fit)
    monkeypatch.setattr(Q, "learnable", lambda spark, sf_dir: rows_of(spark, 10))
    return got


def test_train_rf_trains_the_whole_forest(spark, asked_for):
    """20 trees of depth 8 stood in for it."""
    with pytest.raises(InterruptedError):
        Q.train_rf(spark, "none")
    assert [(e.getNumTrees(), e.getMaxDepth(), e.getMaxBins(), e.getMinInstancesPerNode()) for e in asked_for] == [(300, 30, 256, 2)]


def test_deep_forest_of_the_default_size(spark):
    """`pyspark.ml` alone did not end on this within minutes: it sends a histogram of every small node from every partition."""
    table = rows_of(spark, 600).withColumn("label", F.when(F.xxhash64("row_id") % 10 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    trained, result = MO.fit_and_evaluate(table, MO.forest(), split="random", row_key=["row_id"])
    model, m = trained.model, result.first()
    assert model.getNumTrees == 300 and model.getOrDefault("maxDepth") == 30 and m.roc_auc > 0.7
    assert max(t.depth for t in model.trees) > 5 and len({t.numNodes for t in model.trees}) > 5
    assert abs(sum(model.featureImportances.toArray()) - 1) < 1e-9


def test_a_grown_tree_keeps_the_rules():
    """Every split is the best of the features asked, leaves hold enough rows, counts add up, and equal leaves are one."""
    rng = np.random.default_rng(3)
    rec = np.zeros(3000, D.row_type(5))
    rec["x"] = rng.integers(0, 16, (3000, 5))
    rec["y"] = (rec["x"][:, 0] > 7) ^ (rec["x"][:, 1] > 4) ^ (rng.random(3000) < 0.1)
    rec["w"] = np.where(rec["y"] > 0, 2.0, 0.5)
    t = D.grow(rec, 16, 5, 30, 4, 1.0, 7, 0)
    draw, times = np.random.default_rng([7, 0]), []
    times = draw.poisson(1.0, 3000)
    at, w = np.zeros(3000, int), times * rec["w"]
    for node in range(len(t["left"])):
        here = (at == node) & (times > 0)
        assert times[here].sum() == t["raw"][node] and abs(w[here].sum() - t["weight"][node]) < 1e-6
        assert abs((w * rec["y"])[here].sum() - t["pos"][node]) < 1e-6 and t["raw"][node] >= 4
        if t["left"][node] < 0:
            continue

        def gain(feature, cut):
            def bad(rows):
                p = (w * rec["y"])[rows].sum() / w[rows].sum()
                return 2 * p * (1 - p) * w[rows].sum()
            low = here & (rec["x"][:, feature] <= cut)
            high = here & ~low
            return (bad(here) - bad(low) - bad(high)) / w[here].sum() if min(times[low].sum(), times[high].sum()) >= 4 else -1.0

        assert abs(t["gain"][node] - gain(t["feature"][node], t["cut"][node])) < 1e-9
        if node < 3:
            assert t["gain"][node] >= max(gain(f, c) for f in range(5) for c in range(15)) - 1e-9
        left = rec["x"][:, t["feature"][node]] <= t["cut"][node]
        at[here] = np.where(left, t["left"][node], t["left"][node] + 1)[here]
        low = t["left"][node]
        assert not (t["left"][low] < 0 and t["left"][low + 1] < 0 and t["says"][low] == t["says"][low + 1])


def test_cuts_lie_between_values():
    values = np.array([[1.0, 0.0], [1.0, 1.0], [4.0, 2.0], [6.0, 3.0]])
    few, many = D.cut_points(values, 3)
    assert few.tolist() == [2.5, 5.0] and 1 <= len(many) <= 2 and set(many.tolist()) <= {0.5, 1.5, 2.5}
    assert D.cut_points(np.zeros((4, 1)), 256)[0].tolist() == []


def test_too_many_rows_or_few_levels_are_left_to_the_estimator():
    assert D.fits(MO.forest(), D.TASK_ROWS) and not D.fits(MO.forest(), D.TASK_ROWS + 1)
    assert not D.fits(MO.forest(trees=20, depth=8), 100) and not D.fits(MO.boosted(depth=20), 100)


def test_train_gbt_boosts_in_full(spark, asked_for):
    """5 rounds of depth 4 stood in for it."""
    with pytest.raises(InterruptedError):
        Q.train_gbt(spark, "none")
    assert [(e.getMaxIter(), e.getMaxDepth(), e.getMaxBins(), e.getStepSize(), e.getSubsamplingRate()) for e in asked_for] == [(400, 8, 256, 0.05, 0.9)]


def test_boosting_writes_its_errors_down(spark):
    """Without a folder each round's plan holds those of all rounds before it."""
    trained = MO.train(rows_of(spark, 60).drop("start_time", "row_id"), MO.boosted(rounds=12, depth=2))
    assert not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty() and trained.model.getNumTrees == 12
