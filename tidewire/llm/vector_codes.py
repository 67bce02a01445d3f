"""Product quantisation in whole numbers, with nearest entries found the LAESA way.

The distances of every part to a few fixed pivots are worked out once and kept beside the part. In each round the distances
of the pivots to the codebook's entries (a small table) give, by the triangle inequality, a lower bound for every part and
entry: entries are tried from the smallest bound on, and a part is done as soon as the next bound exceeds the best distance
found. Distances that decide are exact whole numbers; bounds are floats with a margin on the safe side.

Codebooks (parts x entries) are all that reaches the driver. Tasks add up their parts before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.llm.common import release, stored

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 4096, 8, 16, 6, 4
#: Components stay below this after scaling, so that sums of squares are exact.
LARGEST = 1 << 26
#: Labels whose sums are sent to all tasks; more are joined by a shuffle.
MOST_SENT = 100_000


def finite(vector: str | Column) -> Column:
    """Whether a vector is there, with components, none of them null or not finite."""
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))       # NaN is above all numbers


def whole(vector: str | Column, scale: int) -> Column:
    """The components as whole numbers, rounded down."""
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    return F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


def matrix(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def wide(column: pa.Array, width: int) -> np.ndarray:
    """The matrix, whose rows must all have `width` components."""
    if pc.any(pc.not_equal(pc.list_value_length(column), width)).as_py():
        raise ValueError(f"vectors of unlike lengths, {width} and others")
    return matrix(column)


def pivots_of(entries: np.ndarray, most: int) -> np.ndarray:
    """Entries far apart from each other: the first, then each time the one of the largest summed distance to those chosen."""
    chosen, total = [0], np.zeros(len(entries))
    while len(chosen) < min(most, len(entries)):
        total += np.sqrt(((entries - entries[chosen[-1]]) ** 2).sum(1))
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return entries[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, as floats that are off by no more than `margin` allows."""
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in pivots], 1)).astype(np.float32)


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, its squared distance) of each row, ties to the lower index; and how many distances were worked out."""
    between = distances(entries, pivots)
    bound = np.zeros((len(x), len(entries)), np.float32)
    for p in range(len(pivots)):
        a, b = to_pivots[:, p, None], between[None, :, p]
        np.maximum(bound, np.abs(a - b) - (a + b) * np.float32(1e-6), out=bound)
    squared = np.maximum(bound.astype(np.float64), 0) ** 2 * (1 - 1e-6)
    order = np.argsort(squared, 1, kind="stable")
    code, best, done = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max), 0
    open_ = np.arange(len(x))
    for step in range(len(entries)):
        e = order[open_, step]
        go = squared[open_, e] <= best[open_]                            # the others' bounds are all higher still
        open_, e = open_[go], e[go]
        if not len(open_):
            break
        done += len(open_)
        d = ((x[open_] - entries[e]) ** 2).sum(1)
        better = (d < best[open_]) | (d == best[open_]) & (e < code[open_])
        code[open_[better]], best[open_[better]] = e[better], d[better]
    return code, best, done


def codebooks(kept: DataFrame, first: np.ndarray, pivots: list[np.ndarray], parts: int, rounds: int) -> np.ndarray:
    """Entries [part, entry, component] after the rounds; `kept` has whole (list of long) and near (distances to the pivots)."""
    books = first

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            x = matrix(batch.column(0)).reshape(batch.num_rows, parts, -1)
            near = matrix(batch.column(1), np.float32).reshape(batch.num_rows, parts, -1)
            for p in range(parts):
                code, _, _ = nearest(x[:, p], near[:, p], books[p], pivots[p])
                counts[p] += np.bincount(code, minlength=books.shape[1])
                for e in np.unique(code):
                    sums[p, e] += x[code == e, p].sum(0)
        at = np.indices(sums.shape).reshape(3, -1)
        if counts.any():
            yield pa.RecordBatch.from_arrays([*map(pa.array, at.astype(np.int32)), pa.array(sums.ravel()), pa.array(np.repeat(counts.ravel(), sums.shape[2]))],
                                             ["part", "entry", "place", "total", "n"])

    for _ in range(rounds):
        added = kept.mapInArrow(assign, "part int, entry int, place int, total long, n long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for part, entry, place, total, n in added.where("n > 0").collect():             # a row a component of a codebook
            books[part, entry, place] = total // n
    return books


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
                 rounds: int = ROUNDS, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of each row whose vector has components, all of them finite.

    Null, empty and non-finite vectors are left out. Components become floor(scale * x). Codebooks start as the parts of the
    rows of the smallest keys (rows that share a key by their components; null keys last; with fewer rows there are fewer
    entries). Rows that share a key or a vector are rows of their own; null labels count together. Other columns are not read.
    An empty table has no rows. Vectors of unlike lengths, lengths that are no multiple of `parts`, more than 256 entries, and
    components of 2^26 or more after scaling are refused with a ValueError.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    rows = vectors.where(finite(f"`{vector}`")).select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), whole(f"`{vector}`", scale).alias("whole"))
    start = rows.orderBy(F.asc_nulls_last("key"), "whole").limit(entries).collect()
    schema = f"key {kind}, code string, error long"
    if not start:
        return spark.createDataFrame([], f"`{key}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    width = len(start[0]["whole"])
    if width % parts or entries > 256:
        raise ValueError(f"{width} components in {parts} parts, {entries} entries")
    first = np.array([r["whole"] for r in start if len(r["whole"]) == width], np.int64).reshape(-1, parts, width // parts).swapaxes(0, 1)
    fixed = [pivots_of(first[p], pivots) for p in range(parts)]
    key_type, label_type = (to_arrow_type(rows.schema[c].dataType) for c in ("key", "label"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = wide(batch.column(2), width)
            if x.max() >= LARGEST or x.min() < -LARGEST:
                raise ValueError("components are too large for exact sums")
            x = x.reshape(len(x), parts, -1)
            near = np.stack([distances(x[:, p], fixed[p]) for p in range(parts)], 1).reshape(len(x), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], ["key", "label", "whole", "near"])

    label_kind = rows.schema["label"].dataType.simpleString()
    kept = stored(rows.mapInArrow(measure, f"key {kind}, label {label_kind}, whole array<long>, near array<float>"), "parts")
    books = codebooks(kept.select("whole", "near"), first, fixed, parts, rounds)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2)).reshape(batch.num_rows, parts, -1)
            near = matrix(batch.column(3), np.float32).reshape(batch.num_rows, parts, -1)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                codes[:, p], d, _ = nearest(x[:, p], near[:, p], books[p], fixed[p])
                error += d
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(key_type), batch.column(1).cast(label_type), pa.array([text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()),
                                              pa.array(error)], ["key", "label", "code", "error"])
        release()

    coded = stored(kept.mapInArrow(encode, schema.replace("code", f"label {label_kind}, code")), "codes")
    totals = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors").withColumnRenamed("label", "label2")
    if totals.count() <= MOST_SENT:
        totals = F.broadcast(totals)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(totals, F.col("label").eqNullSafe(F.col("label2"))).select(
        F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
