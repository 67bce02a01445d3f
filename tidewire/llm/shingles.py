"""Word shingles of texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: ASCII letters lowered, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words whose hashes a task keeps.
KEPT = 200_000


class Words(dict):
    """Hashes of words, worked out when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = Words()


def forget() -> None:
    """Drops the words kept; a task does so when it ends, as they are soon worked out again."""
    _words.clear()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Distinct shingles of `size` words, sorted. Fewer words are one shingle; no words, none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(_words) > KEPT:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    take = min(size, len(h))
    n = len(h) - take + 1
    total = np.full(n, take, np.uint64)
    for i in range(take):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
    total = np.sort(mix(total))
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def set_id(hashes: np.ndarray) -> int:
    """One signed number for a whole set."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=len(hashes)) - (1 << 63)
