"""Token counts: byte-pair merges of a given vocabulary, on whole batches of pre-tokens at once.

Distinct pre-tokens of a batch are laid end to end in one array of symbols. In each round every sequence finds its pair of
lowest rank and all these pairs merge at the same time; sequences without a pair left drop out. What survives is the count.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import slices

NONE = np.iinfo(np.int32).max
#: Longer pre-tokens merge one pair at a time from a heap: rounds over them would be as many as they are long.
LONG = 400
#: Distinct pre-tokens whose counts a task keeps.
KEPT = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """A byte-level vocabulary in arrays. Symbols are ids; pairs are looked up in a sorted array of keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int64)
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], np.arange(len(pairs), dtype=np.int32)[order]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)            # by rank
        self.table = dict(zip(keys.tolist(), range(len(pairs))))
        self.kept: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merge(self, texts: list[bytes]) -> np.ndarray:
        """How many symbols are left of each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = np.zeros(len(texts), np.int64)
        symbols = self.first[np.frombuffer(b"".join(texts), np.uint8)]
        owner = np.repeat(np.arange(len(texts)), sizes)
        while len(symbols):
            start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            rank = np.full(len(symbols), NONE, np.int32)
            rank[:-1] = np.where(owner[1:] == owner[:-1], self.ranks(symbols[:-1], symbols[1:]), NONE)
            least = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(symbols))))
            ended = least == NONE
            if ended.any():
                counts += np.bincount(owner[ended], minlength=len(texts))
                symbols, owner, rank, least = (a[~ended] for a in (symbols, owner, rank, least))
                if not len(symbols):
                    break
            hit = rank == least
            # of overlapping pairs (a a a) the first, third, ... are taken
            place = np.arange(len(hit))
            began = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, 0))
            hit &= (place - began) % 2 == 0
            symbols = np.where(hit, self.made[np.minimum(rank, len(self.made) - 1)], symbols)
            stays = np.concatenate([[True], ~hit[:-1]])
            symbols, owner = symbols[stays], owner[stays]
        return counts

    def merge_long(self, text: bytes) -> int:
        symbols = self.first[np.frombuffer(text, np.uint8)].tolist()
        n = len(symbols)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1)
                if (r := self.table.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = int(self.made[r]), False, after[j]
            if after[i] < n:
                before[after[i]] = i
            left -= 1
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := self.table.get(symbols[x] << 32 | symbols[y])) is not None:
                    heapq.heappush(heap, (s, x, symbols[x], symbols[y]))
        return left

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; strings of special tokens inside a text count as that one token."""
        found: list[list[str]] = []
        extra = []
        for text in texts:
            parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
            extra.append(len(parts) - 1)
            found.append([w for p in parts for w in self.words.findall(p)])
        if len(self.kept) > KEPT:
            self.kept = {}
        kept = self.kept
        fresh = list({w for words in found for w in words if w not in kept})
        raw = [w.encode() for w in fresh]
        short = [i for i, b in enumerate(raw) if len(b) <= LONG]
        for at in range(0, len(short), 50_000):
            part = short[at:at + 50_000]
            kept.update(zip((fresh[i] for i in part), self.merge([raw[i] for i in part]).tolist()))
        for w, b in zip(fresh, raw):
            if len(b) > LONG:
                kept[w] = self.merge_long(b)
        return [n + sum(map(kept.__getitem__, words)) for n, words in zip(extra, found)]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row's whole text, one row per input row.

    A null text counts as empty: 0 bytes, 0 tokens. A null key stays null, repeated rows are counted each, other columns
    are not read. No shuffle. `tokenizer` is the path of a byte-level vocabulary file that every executor can open.
    """
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts = merges(tokenizer).count([t or "" for t in part.column(1).to_pylist()])
            size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), size, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                ["key", "n_bytes", "n_tokens", "over_limit"])

    counted = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"key {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("key", key)
