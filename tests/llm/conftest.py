import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, words string, h long, t_ string, in0_ int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows and keys, and extra columns under names an operator might use."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["été", "ñandú", "Straße", "x@y.com", "10.0.0.1"]
    passage = " ".join(f"shared{i}" for i in range(55))
    texts = [None, "", " \n\t ", "one", "A b c", passage, "x " * 30_000, "y" * 50_000]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    texts += [t + "\n" + passage for t in texts[-10:]] + texts[-3:]
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 7 == 0 else f"s{i % 2}", len(t or ""), "r", "k", "w", 1, "t", 0) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "no key at all", "en", "s0", 13, "r", "k", "w", 1, "t", 0), (None, None, None, None, None, None, None, None, None, None, None),
             (3, "another text under a known key", "en", "s0", 30, "r", "k", "w", 1, "t", 0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
