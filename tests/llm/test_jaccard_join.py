import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tidewire.llm import components as CO
from tidewire.llm import jaccard_join as JJ
from tidewire.llm.shingles import shingle_set


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if both and 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(rows[i][0], len(sets[i]), low[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))], len(groups)


@pytest.fixture(scope="module")
def copies(spark):
    rng, rows, v = random.Random(3), [], [f"w{i}" for i in range(40)]
    for size in [1, 3, 5, 6, 8, 12, 20, 30, 60, 100, 150] * 2:
        base = [rng.choice(v) for _ in range(size)]
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randrange(0, 2 + size // 12)):
                at = rng.randrange(len(w)) if w else 0
                w[at:at + rng.randrange(2)] = [rng.choice(v)] * rng.randrange(2)
            rows.append((len(rows), " ".join(w)))
    line = " ".join(f"boil{i}" for i in range(40))          # short texts that are mostly one common line
    rows += [(1000 + j, line + " " + " ".join(rng.choice(v) for _ in range(rng.randrange(25)))) for j in range(120)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, "a b c d e f g"), (None, "A b c d e f g"), (2003, "a B c d e f g"), (2003, "a B c d e f g"), (None, "only null keys here at all")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_equals_brute_force(copies):
    want, groups = brute([tuple(r) for r in copies.collect()])
    got = [tuple(r) for r in JJ.jaccard_components(copies).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = JJ.one_of_each(copies.selectExpr("*", "1 AS cls", "'x' AS root", "2 AS mark"))
    assert kept.columns == ["doc_id", "text", "cls", "root", "mark"] and kept.count() == groups


def test_blocks_of_crowded_buckets(copies, monkeypatch):
    monkeypatch.setattr(JJ, "BLOCK", 7)
    monkeypatch.setattr(JJ, "MOST_SENT", 0)
    want, _ = brute([tuple(r) for r in copies.collect()])
    assert sorted(str(tuple(r)) for r in JJ.jaccard_components(copies).collect()) == sorted(map(str, want))


def placed(rng, segments, m):
    """Hashes in the given segments of m."""
    low = rng.integers(0, 1 << 32, len(segments)).astype(np.uint64)
    segments = np.array(segments, np.uint64)
    high = (segments << np.uint64(32)) // np.uint64(m) + np.uint64(1)
    return np.sort(high << np.uint64(32) | low)


def meet(x, y):
    h = (len(x) + len(y)) // 7
    band = int(np.searchsorted(JJ.TOPS, h))
    assert band in JJ.bands_of(len(x)) and band in JJ.bands_of(len(y))
    (a, sure_a), (b, sure_b) = JJ.signatures(x, band), JJ.signatures(y, band)
    assert len(np.intersect1d(a, b)) >= max(sure_a, sure_b, 1)


def spreads(n, m):
    """All ways of n equal elements over m segments."""
    if m == 1:
        yield [n]
        return
    for first in range(n + 1):
        for rest in spreads(n - first, m - 1):
            yield [first, *rest]


def test_small_linked_sets_meet_wherever_their_elements_fall():
    rng, tried = np.random.default_rng(2), 0
    for both in range(3, 10):
        for only_x in range(3):
            for only_y in range(only_x, 4):
                h = (2 * both + only_x + only_y) // 7
                if not 0 < only_x + only_y <= h or 100 * both < 75 * (both + only_x + only_y):
                    continue
                m = JJ.BANDS[int(np.searchsorted(JJ.TOPS, h))][1]
                for common in spreads(both, m):
                    shared = placed(rng, np.repeat(np.arange(m), common), m)
                    for a in spreads(only_x, m):
                        for b in spreads(only_y, m):
                            x = np.union1d(shared, placed(rng, np.repeat(np.arange(m), a), m))
                            y = np.union1d(shared, placed(rng, np.repeat(np.arange(m), b), m))
                            meet(x, y)
                            tried += 1
    assert tried > 10_000


def test_larger_linked_sets_in_few_segments_meet():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        both = int(rng.integers(9, 200))
        h = int(rng.integers(1, both // 3 + 1))
        only_x = int(rng.integers(0, h + 1))
        if 100 * both < 75 * (both + h):
            continue
        m = JJ.BANDS[int(np.searchsorted(JJ.TOPS, (2 * both + h) // 7))][1]
        used = rng.choice(m, int(rng.integers(1, m + 1)), replace=False)
        shared = placed(rng, rng.choice(used, both), m)
        x = np.union1d(shared, placed(rng, rng.choice(used, only_x), m))
        y = np.union1d(shared, placed(rng, rng.integers(0, m, h - only_x), m))
        meet(x, y)


def test_linked_sets_meet_often_enough():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(4, 400))
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        change = int(rng.integers(0, n // 7 + 1))
        y = np.unique(np.concatenate([x[change:], rng.integers(0, 1 << 63, change).astype(np.uint64)]))
        x = np.unique(x)
        both = len(np.intersect1d(x, y))
        if (len(x) + len(y)) // 7 and 100 * both >= 75 * (len(x) + len(y) - both):
            meet(x, y)


def test_texts_whose_shingles_share_one_segment_are_linked(spark):
    rng, rows = random.Random(11), []
    while len(rows) < 12:
        words = [f"v{rng.randrange(10 ** 6)}" for _ in range(12)]
        x, y = shingle_set(" ".join(words)), shingle_set(" ".join(words[:10]))
        if len({int(h >> np.uint64(32)) * 3 >> 32 for h in x}) == 1 and len(x) == 8 and len(y) == 6:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:10]))]
    got = {r.doc_id: r.component_id for r in JJ.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(12)}


def test_awkward_and_empty(awkward, empty):
    want, _ = brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert sorted(str(tuple(r)) for r in JJ.jaccard_components(awkward).collect()) == sorted(map(str, want))
    assert JJ.jaccard_components(empty).count() == 0 and JJ.one_of_each(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.root for r in CO.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 20)) and got[201] == 200
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 30)], "node long, parent long")
    assert {r.root for r in CO.pointer_roots(chain).collect()} == {0}


def test_set_of_a_text():
    assert len(shingle_set("A b  c\td\ne f")) == 2 and len(shingle_set("a")) == 1 and len(shingle_set(None)) == 0
