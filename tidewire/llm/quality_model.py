"""Quality classifier from weak labels.

Seven heuristic labellers vote good, bad or nothing on every document. Expectation maximisation over the counts of vote
combinations (all documents, but at most 3^7 rows) estimates how accurate each labeller is in each class. The posteriors of
a bounded sample train a linear scorer on hashed byte trigrams, which scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import held, released, slices

#: Function words of the four languages; a labeller counts them.
FUNCTION_WORDS = frozenset(w.encode() for w in (
    "the of and to in a is that for it with as was on are by be this from or an at not have "
    "der die und das den von zu mit sich des ist im nicht ein eine als auch es an werden aus er hat dass "
    "le la les de et des en un une du que est pour qui dans par sur au pas avec ne se plus "
    "el los las y del que se por con para una su al lo como más o pero sus").split())
LABELLERS = ("runs", "symbols", "capitals", "letterless", "repeats", "sentences", "function_words")
SIZE = 2048


def runs(words: list[bytes]) -> float:
    """The share of words that repeat the word before."""
    return sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words) - 1)


def windows_again(words: list[bytes]) -> float:
    """The share of three-word windows that stood in the text before."""
    return 1 - len(set(zip(words, words[1:], words[2:]))) / (len(words) - 2) if len(words) > 2 else 0.0


def votes(text: str | None) -> list[int]:
    """1 good, -1 bad, 0 no opinion, in the order of LABELLERS. A text without words is bad by its first labeller alone."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if n == 0:
        return [-1, 0, 0, 0, 0, 0, 0]
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    symbols = int(c[[35, 42, 36, 37, 38, 124, 60, 62, 126, 94, 123, 125]].sum()) / max(1, len(raw) - n)
    letterless = sum(1 for w in words if len(w) < 3 and not w.isalnum() and w < b"\x80") / n
    repeats = windows_again(words)
    ends = sum(1 for w in words if w[-1] in b".?!:;") / n
    function = sum(map(FUNCTION_WORDS.__contains__, words)) / n

    def vote(x: float, good: float, bad: float) -> int:
        """Good up to one bound, bad from the other."""
        return (1 if x <= good else -1 if x >= bad else 0) if good < bad else (1 if x >= good else -1 if x <= bad else 0)

    # where a text is too short for a labeller, it has no opinion
    return [vote(runs(words), 0.05, 0.25) if n >= 10 else 0, vote(symbols, 0.01, 0.04), vote(upper / max(1, upper + lower), 0.15, 0.5), vote(letterless, 0.03, 0.15),
            vote(repeats, 0.1, 0.4) if n >= 30 else 0, vote(ends, 0.02, 0.004) if n >= 60 else 0, vote(function, 0.1, 0.02) if n >= 30 else 0]


def pattern(v: list[int]) -> int:
    number = 0
    for x in v:
        number = number * 3 + x + 1
    return number


def unpacked(number: int) -> list[int]:
    v = []
    for _ in LABELLERS:
        number, x = divmod(number, 3)
        v.append(x - 1)
    return v[::-1]


def features(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the whole text, as square roots of their shares, so that length does not count; and the shares
    of repeated words and windows, which trigrams cannot tell."""
    whole = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(whole, np.uint8).astype(np.uint32)
    x = np.zeros(SIZE + 2, np.float32)
    if len(raw) > 2:
        gram = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761) >> np.uint32(32 - 11)
        x[:SIZE] = np.sqrt(np.bincount(gram, minlength=SIZE) / len(gram))
    words = whole.split()
    if len(words) >= 10:
        x[SIZE:] = np.sqrt([runs(words), windows_again(words)])
    return x


@dataclass
class QualityModel:
    """Vote tables by labeller and class (0 bad, 1 good), the posterior of each combination, and the scorer."""

    tables: np.ndarray
    posterior: dict[int, float]
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def estimate(counted: dict[int, int], rounds: int = 60) -> tuple[np.ndarray, dict[int, float]]:
    """Expectation maximisation for two classes and labellers that may abstain; starts from the votes, objections first."""
    numbers = sorted(counted)
    if not numbers:
        return np.full((len(LABELLERS), 2, 3), 1 / 3), {}
    n = np.array([counted[p] for p in numbers], float)
    v = np.array([unpacked(p) for p in numbers]) + 1
    post = 1 / (1 + np.exp(-2.0 * (v - 1).sum(1)))
    post = np.where((v - 1).min(1) < 0, 0.05, post)         # to begin with, one objection outweighs all praise
    tables = np.zeros((len(LABELLERS), 2, 3))
    tables[:, :, 1] = 1.0                              # no opinion says nothing about the class
    for _ in range(rounds):
        prior = np.clip((n * post).sum() / n.sum(), 0.02, 0.98)
        for j in range(len(LABELLERS)):
            for y, p in ((0, 1 - post), (1, post)):
                bad, _, good = np.bincount(v[:, j], weights=n * p, minlength=3) + 1.0
                tables[j, y, [0, 2]] = bad / (bad + good), good / (bad + good)
        odds = np.log(prior / (1 - prior)) + sum(np.log(tables[j, 1, v[:, j]] / tables[j, 0, v[:, j]]) for j in range(len(LABELLERS)))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return tables, dict(zip(numbers, post.tolist()))


def train(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; both classes weigh the same."""
    if not len(x):
        return np.zeros(SIZE + 2), 0.0
    weight = np.where(y >= 0.5, 0.5 / max(y.sum(), 1.0), 0.5 / max((1 - y).sum(), 1.0))
    mean = x.mean(0)
    x = x - mean
    w, b, mw, mb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    rate = 4.0 / (weight @ (x * x).sum(1) + weight.sum() / len(weight) + 1e-9)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ mw + mb, -30, 30)))
        g = weight * (p - y)
        new_w, new_b = mw - rate * (x.T @ g + ridge * mw), mb - rate * 0.1 * g.sum()
        m = t / (t + 3)
        mw, mb, w, b = new_w + m * (new_w - w), new_b + m * (new_b - b), new_w, new_b
    return w, b - float(mean @ w)


def fitted(docs: DataFrame, key: str, text: str, sample: int) -> QualityModel:
    read = docs.select(F.col(text).cast("string").alias("text"), F.pmod(F.xxhash64(key, text), F.lit(1 << 30)).alias("lot"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([pattern(votes(t)) for t in part.column(0).to_pylist()], pa.int32())], ["pattern"])

    counted = {r["pattern"]: r["n"] for r in read.select("text").mapInArrow(vote, "pattern int").groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n")).collect()}                                   # at most 3^7 rows
    tables, posterior = estimate(counted)
    total = sum(counted.values())
    picked = read.where(F.col("lot") < int((1 << 30) * min(1.0, sample / max(total, 1))) + 1).limit(2 * sample)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([pattern(votes(t)) for t in texts], pa.int32()),
                                              pa.array([features(t).tobytes() for t in texts], pa.binary())], ["pattern", "x"])

    rows = sorted((r["x"], r["pattern"]) for r in picked.select("text").mapInArrow(describe, "pattern int, x binary").collect())   # bounded
    x = np.array([np.frombuffer(r[0], np.float32) for r in rows], float).reshape(-1, SIZE + 2)
    y = np.array([posterior.get(r[1], 0.5) for r in rows])
    weights, bias = train(x, y)
    return QualityModel(tables, posterior, weights, bias)


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 3000, least: float = 0.3,
           model: QualityModel | None = None) -> DataFrame:
    """All columns of docs, with weak_score_ (posterior of the votes), score_ and kept_ (score_ >= least).

    `sample` bounds the documents whose features train the scorer (about as many, picked by a hash of key and text, never
    more than twice as many); votes are counted over all rows. A null text is empty: it has no words, is voted bad for its
    length, and is not kept. Repeated rows get equal scores; null keys and columns of any other name pass through.
    """
    names = docs.columns
    model = model or fitted(docs, key, text, sample)
    rows = held(docs, F.col(f"`{text}`").cast("string").alias("text_"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text_")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_"):
            texts = part.column(part.num_columns - 1).to_pylist()
            score = model.score(np.stack([features(t) for t in texts]).astype(float))
            score = np.where([bool(t and t.strip()) for t in texts], score, 0.0)
            weak = [model.posterior.get(pattern(votes(t)), 0.5) for t in texts]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(weak, pa.float64()), pa.array(score), pa.array(score >= least)],
                                             [*part.schema.names[:-1], "weak_score_", "score_", "kept_"])

    found = rows.mapInArrow(judge, f"{schema}, weak_score_ double, score_ double, kept_ boolean")
    return found.select(*released(names), "weak_score_", "score_", "kept_")
