"""Packing along a space-filling curve: similar documents share training sequences, and next to nothing is padding.

A document's tokens, hashed into a vector and projected to a few dimensions, give it a place on a Hilbert curve. Documents
are range-sorted by that place; a running sum of their lengths (within ranges, then over the few ranges) gives each its
offset in one long stream, and every 2048th position of the stream ends a sequence. Only the last sequence can be short.
Texts are tokenised once; the sort moves keys and lengths, and tokens move once more to meet their offsets.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import WhitespaceSplit

from tidewire.llm.common import slices, stored
from tidewire.llm.tokens import byte_symbols

DIMENSIONS, BITS, BUCKETS = 4, 8, 256
#: Distinct words whose ids a task keeps, in each of two generations; new words that go through the library at once.
KEPT, JOINED = 400_000, 200


class WordIds:
    """Ids of texts by a tokenizer that never looks across white space: each distinct word goes through the library once.

    Words of Latin letters are lowered first, and a final full stop or comma is taken off, as the tokenizer does itself; the
    words that remain are fewer. Words kept longest unused are forgotten.
    """

    def __init__(self, path: str, end: int, kept: int = KEPT):
        self.most = kept
        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.end = np.array([end], self.kind).tobytes()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.suffix, self.bare = model.get("end_of_word_suffix"), None
        if model.get("type") == "BPE" and self.suffix:
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            self.bare = Tokenizer(BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=self.suffix))
            self.bare.pre_tokenizer = WhitespaceSplit()
            self.ends = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(self.suffix)]] = True
            self.symbols = dict(enumerate(byte_symbols()))

    def encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def encode_letters(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Lowered words of letters need the library's merges alone, and end in the one token that closes a word: many at a time."""
        groups = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        lines = [t if t.isascii() else " ".join(w.encode().decode("latin-1").translate(self.symbols) for w in g)
                 for g in groups for t in (" ".join(g),)]
        width = self.kind.itemsize
        for group, e in zip(groups, self.bare.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            raw, at = ids.tobytes(), 0
            for w, cut in zip(group, ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist(), strict=True):
                yield w, raw[at:cut]
                at = cut

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        parts = [_cut(t, self.bare is not None) for t in texts]
        got = [[*map(self.young.get, p)] for p in parts]
        gaps = [[i for i, ids in enumerate(g) if ids is None] for g in got]
        missing = {p[i] for p, at in zip(parts, gaps) for i in at}
        if missing:
            self.learn(missing)
            for p, g, at in zip(parts, got, gaps):
                for i in at:
                    g[i] = self.young[p[i]]
        return [b"".join(g) + self.end for g in got]

    def learn(self, missing: set[str]) -> None:
        """Words of letters are lowered, and lose a final stop or comma, which the tokenizer makes a word of its own."""
        young, old = self.young, self.old
        plain, others = {}, []
        known = missing & old.keys()
        young.update((w, old[w]) for w in known)
        fresh = missing - known if known else missing
        letters = {w for w in fresh if w.isascii() and w.isalpha() and w.islower()} if self.bare else set()
        for w in fresh - letters:
            body = w[:-1] if w.endswith((".", ",")) else w
            if self.bare is None or not is_latin(body):
                others.append(w)
                continue
            low = body.lower()
            if low is not w:
                plain[w] = low, w[len(body):]
            if low not in young:
                if low in old:
                    young[low] = old[low]
                else:
                    letters.add(low)
        marks = [m for m in (".", ",") if m not in young]
        young.update(zip(others + marks, self.encode(others + marks)))
        young.update(self.encode_letters([*letters]))
        for w, (low, mark) in plain.items():
            young[w] = young[low] + young[mark] if mark else young[low]


def is_latin(word: str) -> bool:
    """Only letters that lower to one letter and that no normal form changes."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250" and "\u0130" not in word)


#: A stop or comma that follows another mark belongs to that mark's run.
RUN = re.compile(r"[^a-z0-9 ][.,] ")


def _cut(text: str, lowers: bool) -> list[str]:
    """Pieces between ASCII spaces and line ends; other white space is the library's matter.

    Where the tokenizer lowers and splits off marks itself, plain ASCII texts are lowered and cut before stops and commas
    at once: fewer distinct pieces.
    """
    text = text.replace("\n", " ")
    if lowers and text.isascii() and "<" not in text:
        text = text.lower()
        if RUN.search(text) is None:
            text = text.replace(". ", " . ").replace(", ", " , ")
    return text.split(" ")


@lru_cache(maxsize=2)
def word_ids(path: str, end: int, kept: int = KEPT) -> WordIds:
    return WordIds(path, end, kept)


@lru_cache(maxsize=1)
def projection() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((BUCKETS, DIMENSIONS))


@lru_cache(maxsize=1)
def borders() -> np.ndarray:
    """Cuts of a normal variable into equally likely cells."""
    return np.array([NormalDist().inv_cdf(k / (1 << BITS)) for k in range(1, 1 << BITS)])


def places(ids: list[np.ndarray]) -> np.ndarray:
    """The place of each document on the curve."""
    hashed = np.stack([np.bincount((i.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(24)).astype(np.int64), minlength=BUCKETS)
                       for i in ids]).astype(float)
    hashed -= hashed.mean(1, keepdims=True)
    hashed /= np.maximum(np.linalg.norm(hashed, axis=1, keepdims=True), 1e-9)
    return hilbert(np.searchsorted(borders(), hashed @ projection(), side="right"), BITS)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """The index on the Hilbert curve of each row of coordinates (Skilling's transposed form)."""
    x = x.copy().T
    n = len(x)
    q = 1 << bits - 1
    while q > 1:
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ t)
            x[i] ^= t if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << bits - 1
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[i] >> b & 1)
    return index


def packed(docs: DataFrame, tokenizer: str, end: int = 1, length: int = 2048, key: str = "doc_id", text: str = "text",
           kept: int = KEPT, forget: bool = False) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): one row for each piece of a document.

    A null text is empty and has the closing id alone. Null keys and repeated rows are documents of their own; documents at
    one place of the curve follow each other in the order they were read. Sequences are numbered from 0 and full but for the
    last. Other columns are not read. An empty table has no pieces. `kept` bounds the words a worker remembers, and
    `forget` drops them when a task ends: both bound memory and do not show in the result.
    """
    kind, key_type = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)
    wide = np.dtype("<u4")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer, end, kept)
        for part in slices(batches, "text"):
            raw = encode([t or "" for t in part.column(1).to_pylist()])
            ids = [np.frombuffer(r, encode.kind) for r in raw]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(places(ids)), pa.array(map(len, ids), pa.int64()),
                                              pa.array(raw, pa.binary()), pa.array([encode.kind.itemsize] * len(ids), pa.int32())],
                                             ["key", "place", "n", "ids", "width"])
        if forget:
            encode.young, encode.old = {}, {}

    tokens = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        tokenise, f"key {kind}, place long, n long, ids binary, width int")
    tokens = stored(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")
    ranged = stored(tokens.select("row", "place", "n").repartitionByRange("place", "row").withColumn("range", F.spark_partition_id()), "order")
    sums = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).collect())     # a row a range
    before, base = 0, []
    for at, n in sums:
        base.append((at, before))
        before += n
    bases = F.broadcast(docs.sparkSession.createDataFrame(base, "range int, base long"))
    run = Window.partitionBy("range").orderBy("place", "row").rowsBetween(Window.unboundedPreceding, 0)
    offsets = ranged.withColumn("upto", F.sum("n").over(run)).join(bases, "range").select("row", (F.col("base") + F.col("upto") - F.col("n")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ids"):
            rows = []
            for k, at, raw, width in zip(*(part.column(c).to_pylist() for c in ("key", "at", "ids", "width"))):
                ids = np.frombuffer(raw, f"<u{width}").astype(wide)
                a = 0
                while a < len(ids):
                    sequence, offset = divmod(at + a, length)
                    b = min(len(ids), a + length - offset)
                    piece = ids[a:b].tobytes()
                    rows.append((k, a, b - a, zlib.crc32(piece), len(ids), sequence, offset, piece))
                    a = b
            if rows:
                types = (key_type, *[pa.int64()] * 6, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], NAMES)

    found = tokens.select("row", "key", "ids", "width").join(offsets, "row").select("key", "at", "ids", "width").mapInArrow(
        cut, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return found.withColumnRenamed("key", key)


NAMES = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
