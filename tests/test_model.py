import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import model as MO
from tidewire.operators.explain import attributions, explain, flat_tree
from tidewire.schemas import FEATURE_NAMES


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(42)
    rows = []
    for label, beacon, entropy in ((0, 1.5, 3.0), (1, 0.05, 7.5)):
        x = rng.normal(size=(500, 34))
        x[:, FEATURE_NAMES.index("beacon_score")] += beacon
        x[:, FEATURE_NAMES.index("payload_entropy")] += entropy
        rows += [(*map(float, r), label, float(i), f"{label}-{i}") for i, r in enumerate(x)]
    schema = ", ".join(f"{n} float" for n in FEATURE_NAMES) + ", label bigint, start_time double, row_id string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def fitted(table):
    return MO.fit_and_evaluate(table, MO.forest(trees=30, depth=8), split="random", dataset="made", row_key=["row_id"])


def test_forest_separates(fitted):
    trained, result = fitted
    m = result.first()
    assert m.f1 > 0.95 and m.pr_auc > 0.95 and m.balanced_accuracy > 0.95 and m.mcc > 0.90
    assert trained.metadata["n_train"] == 750 and trained.metadata["n_test"] == 250
    assert trained.metadata["class_counts"] == {"benign": 375, "c2": 375}


def test_save_and_load(spark, table, fitted, tmp_path, caplog):
    import json
    trained = fitted[0]
    MO.save(trained, spark, str(tmp_path / "m"))
    again = MO.load(spark, str(tmp_path / "m"))
    assert again.metadata == json.loads(json.dumps(trained.metadata))
    a = MO.predict(trained, table).agg(F.sum("proba_c2")).first()[0]
    assert MO.predict(again, table).agg(F.sum("proba_c2")).first()[0] == pytest.approx(a)
    other = MO.Trained(trained.model, {"bundle_version": 2})
    MO.save(other, spark, str(tmp_path / "newer"))
    with pytest.raises(ValueError, match="later release"):
        MO.load(spark, str(tmp_path / "newer"))
    MO.save(MO.Trained(trained.model, {"feature_names": ["a"]}), spark, str(tmp_path / "odd"))
    with caplog.at_level("WARNING"):
        MO.load(spark, str(tmp_path / "odd"))
    assert "other features" in caplog.text


def test_attributions_add_up(table, fitted):
    scored = explain(fitted[0], MO.predict(fitted[0], table))
    gap = F.abs(F.aggregate(F.map_values("shap"), F.lit(0.0), lambda a, v: a + v) + F.col("shap_base") - F.col("proba_c2"))
    row = scored.agg(F.max(gap), F.count(F.lit(1)), F.max(F.size("shap"))).first()
    assert row[0] < 1e-9 and row[1] == 1000 and row[2] == 34


def test_boosted_attributions_add_up(table):
    trained = MO.train(table, MO.boosted(rounds=4, depth=3))
    scored = explain(trained, MO.predict(trained, table))
    total = F.aggregate(F.map_values("shap"), F.lit(0.0), lambda a, v: a + v) + F.col("shap_base")
    assert scored.agg(F.max(F.abs(1 / (1 + F.exp(-total)) - F.col("proba_c2")))).first()[0] < 1e-9


def test_attributions_equal_definition():
    # id: left, right, feature, threshold, cover, value; feature 0 is asked twice on one path
    nodes = {0: (1, 2, 0, 0.5, 10.0, 0), 1: (3, 4, 1, 0.0, 6.0, 0), 2: (5, 6, 2, 1.0, 4.0, 0), 3: (-1, -1, -1, 0, 2.0, 0.3),
             4: (7, 8, 0, -1.0, 4.0, 0), 5: (-1, -1, -1, 0, 1.0, 0.9), 6: (-1, -1, -1, 0, 3.0, 0.1),
             7: (-1, -1, -1, 0, 1.0, 0.6), 8: (-1, -1, -1, 0, 3.0, 0.8)}

    def expect(at, x, known):
        left, right, f, t, cover, value = nodes[at]
        if left < 0:
            return value
        if f in known:
            return expect(left if x[f] <= t else right, x, known)
        return sum(nodes[c][4] / cover * expect(c, x, known) for c in (left, right))

    rng = np.random.default_rng(1)
    xs = rng.normal(size=(20, 3)) * 1.5
    phi, base = attributions(xs, [flat_tree(*map(np.array, zip(*[nodes[i] for i in sorted(nodes)])), 3)])
    for x, got in zip(xs, phi):
        for i in range(3):
            others = [j for j in range(3) if j != i]
            want = 0
            for r in range(3):
                for s in itertools.combinations(others, r):
                    w = math.factorial(r) * math.factorial(2 - r) / math.factorial(3)
                    want += w * (expect(0, x, {*s, i}) - expect(0, x, set(s)))
            assert got[i] == pytest.approx(want, abs=1e-12)
    assert base == pytest.approx(expect(0, xs[0], set()))


def test_attributions_in_files_of_few_trees_and_of_stumps(spark, table):
    """The same sums however the trees are dealt over files; a tree without a split explains nothing."""
    trained = MO.train(table, MO.forest(trees=12, depth=30))
    scored = MO.predict(trained, table)
    whole, dealt = (explain(trained, scored, n).select("row_id", "shap", "shap_base").collect() for n in (10**6, 40))
    assert len({r.row_id for r in whole}) == 1000
    other = {r.row_id: r for r in dealt}
    for r in whole:
        assert other[r.row_id].shap == pytest.approx(r.shap, abs=1e-12) and other[r.row_id].shap_base == pytest.approx(r.shap_base)
    phi, base = attributions(np.zeros((2, 3)), [flat_tree(*map(np.array, ([-1], [-1], [-1], [0.0], [5.0], [0.4])), 3)])
    assert base == pytest.approx(0.4) and not phi.any()


def test_one_class_and_unknown_feature(table):
    with pytest.raises(ValueError, match="one class"):
        MO.train(table.filter("label = 0"), MO.forest(trees=2, depth=2))
    with pytest.raises(ValueError, match="unknown features"):
        MO.fit_and_evaluate(table, zeroed=["nope"])


def test_importance(spark, fitted):
    top = [r.feature for r in MO.feature_importance(fitted[0], spark, 2).collect()]
    assert set(top) == {"beacon_score", "payload_entropy"}


def test_metrics_leave_nothing_cached(spark):
    from tidewire.operators import metrics
    scored = spark.createDataFrame([(i / 50, i % 2) for i in range(50)], "proba_c2 double, label long")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert metrics.evaluate(scored).count() == metrics.ranking_metrics(scored).count() == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
