import random

import public_tokenizers
from tokenizers import Tokenizer

from tidewire.llm import tokens as TK

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)]


def test_counts_equal_the_library():
    rng = random.Random(1)
    alphabet = [chr(c) for c in range(0x20, 0x3100)] + list("etaoin  \n\t''") * 300 + ["<|endoftext|>", "\U0001f600", "aaaa", "é"] * 60
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts += ["", "a" * 1000, "ab" * 5000, "<|endoftext|>", " <|endoftext|>\n", "don't I'LL we've", "12345½Ⅷ", "日本語" * 300]
    assert TK.merges(PATH).count(texts) == library(texts)


def test_every_character():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    texts = [f"a{c}a {c}1{c}, {c}\n {c}" for c in chars]
    assert TK.merges(PATH).count(texts) == library(texts)


def test_table(awkward, empty):
    rows = awkward.collect()
    got = TK.token_counts(awkward, PATH, limit=50).collect()
    want = sorted((r.doc_id is None, r.doc_id, len((r.text or "").encode()), n, n > 50)
                  for r, n in zip(rows, library([r.text or "" for r in rows])))
    assert sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got if r.doc_id is not None) == [w for w in want if not w[0]]
    assert len(got) == len(rows) and TK.token_counts(empty, PATH).count() == 0
