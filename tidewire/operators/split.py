"""Train and test sides."""

from __future__ import annotations

import logging
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.scalar import is_finite
from tidewire.operators import skew

log = logging.getLogger(__name__)


def time_split(table: DataFrame, test_size: float = 0.25, row_key: list[str] | None = None) -> DataFrame:
    """Adds `is_test`: the last rows by start_time; the first int(n * (1 - test_size)) train.

    Rows without a time (null or not finite) come after all others. Equal times are told apart by md5 of the row key.
    Without distinct times it falls back to a random split.
    """
    key = [F.col(c).cast("string") for c in row_key or table.columns]
    ordered = table.withColumns({
        "_t": F.when(is_finite(F.col("start_time")), F.round(F.col("start_time") * 1e6)).cast("bigint"), "_h": skew.hash60(*key)})
    places = ordered.select("_t", "_h").persist()
    try:
        low, high, n = places.agg(F.min("_t"), F.max("_t"), F.count(F.lit(1))).first()
        if low == high:
            log.warning("start_time does not vary; using the stratified random split")
            return random_split(table, test_size, row_key=row_key)
        last = F.coalesce("_t", F.lit(high + 1))
        ordered, whole = ordered.withColumn("_t", last), places.withColumn("_t", last)
        ranges = {"_t": (low, high + 1), "_h": skew.HASH_RANGE}
        test, cut = skew.first_k(whole, ["_t", "_h"], int(n * (1.0 - test_size)), ranges)
    finally:
        places.unpersist()
    marked = skew.mark(ordered, [(F.lit(True), test, cut)], ["_t", "_h"], "_train")
    return marked.withColumn("is_test", ~F.col("_train")).drop("_t", "_h", "_train")


def train_quotas(counts: dict[int, int], test_size: float) -> dict[int, int]:
    """Rows per class on the training side: proportional, whole, largest remainders first."""
    n = sum(counts.values())
    n_train = n - math.ceil(n * test_size)
    shares = {label: count * n_train / n for label, count in counts.items()}
    quota = {label: math.floor(s) for label, s in shares.items()}
    left = n_train - sum(quota.values())
    for label in sorted(shares, key=lambda c: (quota[c] - shares[c], c))[:left]:
        quota[label] += 1
    return quota


def random_split(
    table: DataFrame, test_size: float = 0.25, seed: int = 42, row_key: list[str] | None = None,
) -> DataFrame:
    """Adds `is_test`, stratified by label and repeatable: md5 of seed and row key orders each class."""
    key = [F.col(c).cast("string") for c in row_key or table.columns]
    hashed = table.withColumn("_h", skew.hash60(F.lit(str(seed)), *key))
    counts = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}    # one row per class
    tests = []
    for label, quota in sorted(train_quotas(counts, test_size).items()):
        mine = F.col("label") == label
        tests.append((mine, *skew.first_k(hashed.filter(mine), ["_h"], quota, {"_h": skew.HASH_RANGE})))
    return skew.mark(hashed, tests, ["_h"], "_train").withColumn("is_test", ~F.col("_train")).drop("_h", "_train")


def split_ranges(split: DataFrame) -> DataFrame:
    """Rows, classes and time range of each side."""
    return split.groupBy("is_test").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label") == 0).alias("n_benign"),
        F.count_if(F.col("label") == 1).alias("n_c2"),
        F.min("start_time").alias("t_first"), F.max("start_time").alias("t_last"),
    )


def single_class_check(split: DataFrame) -> DataFrame:
    """Per side: does it hold both classes? (min and max, so nothing distinct is collected)"""
    return split.groupBy("is_test").agg((F.min("label") != F.max("label")).alias("both_classes"))
