import hashlib
import re

import pytest

from tidewire.llm import decontaminate as DC

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, size):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(size, len(v))
        windows = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                ids.add("" if item is None else str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [DC.MAX_SET, 0])
@pytest.mark.parametrize("size", [3, 10])
def test_equals_brute_force(spark, awkward, most, size):
    texts = [r.text for r in awkward.collect() if r.text]
    items = [(1, " ".join(texts[20].split()[3:20])), (2, "ONE!"), (10, texts[25]), (None, "été ñandú"), (4, None), (5, "..."), (6, texts[25]), (7, "it's \\ 'quoted'")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = DC.contamination(awkward, tests, size, most=most).collect()
    want = sorted(str((r.doc_id, *brute(r.text, items, size))) for r in awkward.collect())
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in got) == want
    assert all(len(r.spans) == r.n_hit for r in got)
    clean = DC.remove_documents(awkward, tests, size, most=most)
    assert clean.columns == awkward.columns
    assert sorted(str(r) for r in clean.collect()) == sorted(str(r) for r in awkward.collect() if not brute(r.text, items, size)[4])


def test_spans_go_and_the_rest_stays(spark):
    docs = spark.createDataFrame([(1, "Keep this, One two  three! and that."), (2, None), (3, "nothing")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "one TWO three")], "item_id long, text string")
    got = {r.doc_id: r.text for r in DC.remove_spans(docs, tests, 3).collect()}
    assert got == {1: "Keep this,    ! and that.", 2: None, 3: "nothing"}


def test_empty_tables(spark, awkward, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert DC.contamination(empty, one).count() == 0
    assert DC.contamination(awkward, none).where("contaminated").count() == 0
    assert DC.remove_documents(awkward, none).count() == awkward.count() and DC.remove_documents(empty, one).count() == 0
