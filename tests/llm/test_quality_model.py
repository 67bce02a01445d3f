import numpy as np

from tidewire.llm import quality_model as QM

DATA = "/root/testdata/sf0.01"


def test_labels_held_out(spark):
    """The labels table is never trained on: the classifier has to agree with it."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = QM.scored(docs).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").select("quality", "kept_").collect()
    good, bad = ([r.kept_ for r in found if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_estimates_recover_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(40_000) < 0.8
    accuracy = [0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.6]
    v = np.stack([np.where(rng.random(len(truth)) < a, truth, ~truth) * 2 - 1 for a in accuracy], 1)
    v[rng.random(v.shape) < 0.2] = 0
    counted = {}
    for row in v.tolist():
        counted[QM.pattern(row)] = counted.get(QM.pattern(row), 0) + 1
    tables, posterior = QM.estimate(counted)
    assert np.allclose([t[1][2] for t in tables], accuracy, atol=0.03)
    guess = np.array([posterior[QM.pattern(r)] for r in v.tolist()]) > 0.5
    assert (guess == truth).mean() > 0.97
    assert all(QM.unpacked(QM.pattern(r)) == r for r in v[:50].tolist())


def test_awkward_and_empty(awkward, empty):
    got = QM.scored(awkward, sample=20)
    assert got.columns == [*awkward.columns, "weak_score_", "score_", "kept_"]
    rows = got.collect()
    assert len(rows) == awkward.count() and not any(r.kept_ for r in rows if not (r.text or "").strip())
    assert len({r.score_ for r in rows if r.doc_id == 9}) == 1 and all(0 <= r.score_ <= 1 for r in rows)
    assert QM.scored(empty).count() == 0
