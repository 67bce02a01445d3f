import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewire.llm import packing as PK

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_library():
    rng = random.Random(1)
    alphabet = [chr(c) for c in range(0x3000)] + list("etaoin  \n\t'.,") * 300 + ["<|endoftext|>", "ß.", "É,", "İ"] * 50
    texts = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(1500)]
    texts += ["", "  ", "A<|ENDOFTEXT|>.", "it's. I'M, don't.", "é. ́, á,", " x y", "ΣΑΣ, ς.", "a.b,c.,", "\x85a b", "x" * 3000]
    library, ours = Tokenizer.from_file(PATH), PK.word_ids(PATH, 1)
    got = [np.frombuffer(i, ours.kind).tolist() for part in range(0, len(texts), 200) for i in ours(texts[part:part + 200])]
    assert got == [[*e.ids, 1] for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_hilbert_curve_steps_to_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = PK.hilbert(grid, 3)
    assert sorted(index.tolist()) == list(range(512))
    assert np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(1).max() == 1


def test_round_trip(awkward, empty):
    rows = awkward.collect()
    pieces = PK.packed(awkward, PATH, length=64).collect()
    library = Tokenizer.from_file(PATH)
    want = sorted(str((r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in rows)
    by_place = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
    # in stream order the pieces of a document follow each other
    docs, at = [], 0
    for p in by_place:
        assert p.sequence_id * 64 + p.offset == at
        at += p.length
        ids = np.frombuffer(p.ids, "<u4").tolist()
        if p.start:
            assert docs[-1][0] == p.doc_id and len(docs[-1][1]) == p.start
            docs[-1][1].extend(ids)
        else:
            docs.append((p.doc_id, ids))
    assert sorted(map(str, docs)) == want
    assert PK.packed(empty, PATH).count() == 0


def test_like_documents_are_neighbours(spark):
    rng = random.Random(2)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(6)]
    rows = [(i, " ".join(rng.choice(topics[i % 6]) for _ in range(80))) for i in range(120)]
    pieces = PK.packed(spark.createDataFrame(rows, "doc_id long, text string"), PATH).where("start = 0").orderBy("sequence_id", "offset").collect()
    topic = [p.doc_id % 6 for p in pieces]
    assert sum(a == b for a, b in zip(topic, topic[1:])) > 60          # by chance about 20
