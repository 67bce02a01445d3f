import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as CP
from tests.llm.test_jaccard_join import shingles
from tidewire.llm import decontaminate, quality_model
from tidewire.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Every stage works on what the one before kept, and its decisions take effect."""
    docs = table(spark, SF, "documents")
    kept = [docs]
    for name, stage in CP.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF), name))
    raw, good, lines, single, clean, pieces = kept
    assert all(d.columns == raw.columns for d in (good, lines, single, clean))
    scores = {r.doc_id: r.kept_ for r in quality_model.scored(raw).collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, k in scores.items() if k}
    before = {r.doc_id: r.text for r in good.collect()}
    for r in lines.collect():
        assert r.n_chars == len(r.text) and (r.text == before[r.doc_id] or len(r.text) < len(before[r.doc_id]))
    sets = [(r.doc_id, shingles(r.text)) for r in lines.collect()]
    stay = {r.doc_id for r in single.collect()}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                assert not (a in stay and b in stay)
    assert decontaminate.contamination(clean, table(spark, SF, "benchmark")).where("contaminated").count() == 0
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.collect()}
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in pieces.collect())


def test_run_equals_the_stages(spark):
    """Pieces of every document, with their tokens; which sequence holds them is left out, as equal places may swap."""
    assert [n for n, _ in CP.STAGES] == ["quality", "line_dedup", "near_copies", "decontaminate", "packing"]
    docs = table(spark, SF, "documents")
    for name, stage in CP.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
    tokens = {}
    for r in CP.run(spark, SF).orderBy("doc_id", "start").collect():
        assert len(tokens.setdefault(r.doc_id, [])) == r.start
        tokens[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert tokens == {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}


def test_stages_take_awkward_rows_and_clashing_names(spark, awkward, empty):
    def clashing(docs):
        return docs.selectExpr("*", "true AS kept_", "7L AS n_removed_", "0.5D AS score_", "'x' AS in1_")

    docs = clashing(awkward)
    for name, stage in CP.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        rows = got.collect()
        assert all(r.kept_ and r.n_removed_ == 7 and r.score_ == 0.5 and r.in1_ == "x" for r in rows)
        texts = [r.text for r in rows]
        if name == "quality":
            assert all(t and t.strip() for t in texts)
        else:
            assert None in texts and "" in texts                    # what has no words is nobody's copy
        assert stage(spark, clashing(empty), SF).count() == 0
    pieces = stored(CP.STAGES[-1][1](spark, docs, SF), "pieces")
    assert pieces.where("start = 0").count() == docs.count()
    assert CP.STAGES[-1][1](spark, clashing(empty), SF).count() == 0
