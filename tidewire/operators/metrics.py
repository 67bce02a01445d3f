"""Quality of a scored table (`label` 0/1, `proba_c2`)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.scalar import ratio_or
from tidewire.operators import skew

METRICS = ["precision", "recall", "f1", "fpr", "fnr", "pr_auc", "balanced_accuracy", "mcc", "roc_auc"]
COUNTS = ["tn", "fp", "fn", "tp"]


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    positive, predicted = F.col("label") == 1, F.col("proba_c2") >= threshold
    return scored.agg(
        F.count_if(~positive & ~predicted).alias("tn"), F.count_if(~positive & predicted).alias("fp"),
        F.count_if(positive & ~predicted).alias("fn"), F.count_if(positive & predicted).alias("tp"),
    )


def _zero(a: Column, b: Column) -> Column:
    return ratio_or(a, b, 0.0)


def _rates() -> list[Column]:
    """The threshold metrics from columns tn, fp, fn, tp; every ratio is 0 where its denominator is."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in COUNTS)
    # balanced accuracy averages the recalls of the classes that occur
    recalls = F.when(tp + fn == 0, _zero(tn, tn + fp)).when(tn + fp == 0, _zero(tp, tp + fn)).otherwise(
        (_zero(tp, tp + fn) + _zero(tn, tn + fp)) / 2)
    root = F.sqrt((tp + fp) * (tp + fn)) * F.sqrt((tn + fp) * (tn + fn))
    return [
        _zero(tp, tp + fp).alias("precision"), _zero(tp, tp + fn).alias("recall"),
        _zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _zero(fp, fp + tn).alias("fpr"), _zero(fn, fn + tp).alias("fnr"),
        recalls.alias("balanced_accuracy"), _zero(tp * tn - fp * fn, root).alias("mcc"),
    ]


def classification_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return confusion(scored, threshold).select(*COUNTS, *_rates())


def score_groups(scored: DataFrame) -> DataFrame:
    """Rows per distinct score and class: ties merge before anything is ordered."""
    return scored.groupBy(F.col("proba_c2").alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def score_curve(scored: DataFrame, bins: int = 1024, small: int = skew.SMALL_ROWS) -> DataFrame:
    """Per distinct score, from the top: `tp`, `fp` at or above it, and the totals `p`, `n`.

    Prefix sums in two levels: scores fall into about equal bins, sums of whole bins (at most `bins` rows)
    carry over, and a window inside each bin does the rest. A short score list needs one bin only.
    """
    return curve_of(score_groups(scored), bins, small)


def curve_of(groups: DataFrame, bins: int = 1024, small: int = skew.SMALL_ROWS) -> DataFrame:
    """As `score_curve`, from the rows per score. Reads them three times."""
    if skew.is_small(groups, small):
        binned = groups.withColumn("bin", F.lit(0))
    else:
        edges = sorted(set(groups.approxQuantile("score", [i / bins for i in range(1, bins)], 0.5 / bins)))
        place = skew.count_at_most(F.array(*[F.lit(e) for e in edges]), F.col("score"), len(edges))
        binned = groups.withColumn("bin", place)
    per_bin = binned.groupBy("bin").agg(F.sum("pos").alias("bin_pos"), F.sum("neg").alias("bin_neg"))
    higher = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    carried = per_bin.select(                                                    # at most `bins` rows
        "bin", F.coalesce(F.sum("bin_pos").over(higher), F.lit(0)).alias("above_pos"),
        F.coalesce(F.sum("bin_neg").over(higher), F.lit(0)).alias("above_neg"),
        F.sum("bin_pos").over(every).alias("p"), F.sum("bin_neg").over(every).alias("n"))
    inside = Window.partitionBy("bin").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        binned.withColumns({"run_pos": F.sum("pos").over(inside), "run_neg": F.sum("neg").over(inside)})
        .join(F.broadcast(carried), "bin")
        .select("score", "pos", "neg", (F.col("run_pos") + F.col("above_pos")).alias("tp"),
                (F.col("run_neg") + F.col("above_neg")).alias("fp"), "p", "n")
    )


def _ranking() -> list[Column]:
    """Average precision and ROC-AUC (ties counted half) as aggregates over the curve; 0 when a class is missing."""
    pos, neg, tp, fp, p, n = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp", "p", "n"))
    both = F.coalesce(F.max((p > 0) & (n > 0)), F.lit(False))
    return [
        F.when(both, F.sum(_zero(pos * tp, p * (tp + fp)))).otherwise(0.0).alias("pr_auc"),
        F.when(both, F.sum(_zero(neg * (tp - pos / 2), p * n))).otherwise(0.0).alias("roc_auc"),
    ]


def _over_curve(scored: DataFrame, then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row worked out over the curve at once: the counts per score are kept while it is made, and no longer."""
    groups = score_groups(scored).persist()
    try:
        result = then(curve_of(groups))
        return skew.frozen(scored.sparkSession, [tuple(r) for r in result.collect()], result.schema)        # one row
    finally:
        groups.unpersist()


def ranking_metrics(scored: DataFrame) -> DataFrame:
    return _over_curve(scored, lambda curve: curve.agg(*_ranking()))


def per_class_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support of both classes, their mean, and their mean by support."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))

    def row(name, hit, missed, false):
        return F.struct(
            F.lit(name).alias("class"), _zero(hit, hit + false).alias("precision"),
            _zero(hit, hit + missed).alias("recall"), _zero(2 * hit, 2 * hit + missed + false).alias("f1"),
            (hit + missed).cast("bigint").alias("support"))

    both = confusion(scored, threshold).select(row("benign", tn, fp, fn).alias("b"), row("c2", tp, fn, fp).alias("c"))
    support = F.col("b.support") + F.col("c.support")

    def mean(name, value):
        return F.struct(F.lit(name).alias("class"), *[value(m).alias(m) for m in ("precision", "recall", "f1")],
                        support.alias("support"))

    macro = mean("macro", lambda m: (F.col(f"b.{m}") + F.col(f"c.{m}")) / 2)
    weighted = mean("weighted", lambda m: _zero(
        F.col(f"b.{m}") * F.col("b.support") + F.col(f"c.{m}") * F.col("c.support"), support))
    return both.select(F.inline(F.array(F.col("b"), F.col("c"), macro, weighted)))


def evaluate(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The nine metrics and the four counts in one row, all from the counts per distinct score."""
    hit = F.col("score") >= threshold

    def rows(side, test):
        return F.coalesce(F.sum(F.when(test, F.col(side))), F.lit(0)).cast("bigint")

    def measured(curve: DataFrame) -> DataFrame:
        sums = curve.agg(
            rows("neg", ~hit).alias("tn"), rows("neg", hit).alias("fp"), rows("pos", ~hit).alias("fn"),
            rows("pos", hit).alias("tp"), *_ranking())
        return sums.select(*COUNTS, *_rates(), "pr_auc", "roc_auc").select(*COUNTS, *METRICS)

    return _over_curve(scored, measured)


def cross_dataset_eval(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Independent traffic: flows flagged, share, highest probability."""
    flagged = F.count_if(F.col("proba_c2") >= threshold)
    return scored.agg(
        F.count(F.lit(1)).alias("total_flows"), flagged.alias("flagged_flows"), F.max("proba_c2").alias("max_proba"),
    ).withColumn("flagged_rate", _zero(F.col("flagged_flows"), F.col("total_flows")))


def fail_gate(scored: DataFrame, limit: float) -> DataFrame:
    """Does the highest probability reach the limit?"""
    return scored.agg(F.coalesce(F.max("proba_c2") >= limit, F.lit(False)).alias("failed"))
