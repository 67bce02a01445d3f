"""Flows and their given labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_labels(labels: DataFrame) -> DataFrame:
    """One label per flow_id: that of its last row. Expects `flow_id, label (0/1), row_no`."""
    return labels.groupBy("flow_id").agg(F.max_by("label", "row_no").alias("label"))


def label_join(flows: DataFrame, labels: DataFrame) -> DataFrame:
    """Flows with a label; a label holds for every flow of that id. Heavy ids are left to the engine's skew join."""
    return flows.join(last_labels(labels), "flow_id")


def unmatched_flows(flows: DataFrame, labels: DataFrame) -> DataFrame:
    return flows.join(labels.select("flow_id"), "flow_id", "left_anti")


def class_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


def class_balance(table: DataFrame) -> DataFrame:
    """benign, c2 and their ratio (benign over c2, at least 1)."""
    counts = table.agg(F.count_if(F.col("label") == 0).alias("benign"), F.count_if(F.col("label") == 1).alias("c2"))
    return counts.withColumn("imbalance", F.col("benign") / F.greatest(F.col("c2"), F.lit(1)))


def scenario_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("label"), F.lit(0)).alias("n_c2"))


def class_weights(table: DataFrame) -> DataFrame:
    """Per class n / (classes * n_class), and benign / c2 for boosted trees; from one pass, a row per class present."""
    n = [F.col("n0"), F.col("n1")]
    classes = sum((F.when(c > 0, 1).otherwise(0) for c in n), F.lit(0))
    counts = table.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    rows = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("label"), c.alias("n_rows"),
                 F.try_divide(n[0] + n[1], classes * c).alias("weight"), F.try_divide(n[0], n[1]).alias("pos_weight"))
        for i, c in enumerate(n)
    ])
    return counts.select(F.inline(rows)).filter("n_rows > 0")
