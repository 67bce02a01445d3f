"""Quality rules whose cut-offs adapt to each language and source.

Every document gives a few counts and, from them, feature values in whole steps. A group's sketch of a feature is its
histogram over those steps: such sketches add up exactly, in any order, so those of sources merge into those of languages
and of the corpus, and a quantile read from one is off by less than one step. The cut-offs are Tukey fences around the
quartiles of the finest level that has enough documents; documents are then joined to the fences of their group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.scalar import bind
from tidewire.llm.common import stored

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Feature:
    """A value in steps of 1/`steps`; `slack` steps are always allowed beyond the quartiles."""

    name: str
    above: str            # SQL of numerator and denominator, whole numbers
    below: str
    steps: int
    slack: int
    two_sided: bool = False


FEATURES = (
    Feature("symbols", "n_symbols", "word_chars", 1000, 50),
    Feature("dup_lines", "n_dup_lines", "n_lines", 1000, 300),
    Feature("repeats", "n_repeat_words", "n_words", 1000, 200),
    Feature("capitals", "n_upper", "word_chars", 1000, 200),
    Feature("word_length", "word_chars", "n_words", 20, 40, two_sided=True),
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    fence: int = 3                # times the distance between the quartiles
    min_group: int = 200          # documents a group needs for fences of its own


def counts(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep and the counts of every row's whole text, in the row; a null text has no words."""
    whole = bind(docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t_")), {
        "words_": F.array_remove(F.split("t_", SPACE + "+"), ""),
        "lines_": F.filter(F.split("t_", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": F.regexp_count("t_", F.lit(SYMBOLS)).cast("long"),
        "n_upper": F.regexp_count("t_", F.lit(r"\p{Lu}")).cast("long"),
    })
    windows = F.when(F.size("words_") > 2, F.expr(
        "transform(sequence(1, size(words_) - 2), i -> xxhash64(slice(words_, i, 3)))")).otherwise(F.array().cast("array<bigint>"))
    whole = bind(whole, {"windows_": windows})
    # equal windows stand side by side once sorted; most texts have none and are not sorted
    order = F.when(F.size("windows_") > F.size(F.array_distinct("windows_")), F.sort_array(
        F.transform("windows_", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).otherwise(F.array())
    whole = bind(whole, {"order_": order})
    twice = bind(whole, {"twice_": F.filter(F.transform("order_", lambda x, i: F.when(
        (F.get("order_", i - 1).h == x.h) | (F.get("order_", i + 1).h == x.h), x.p)), lambda p: p.isNotNull())})
    covered = F.size(F.array_distinct(F.flatten(F.transform("twice_", lambda p: F.array(p, p + 1, p + 2)))))
    return twice.select(
        *keep, F.size("words_").cast("long").alias("n_words"), F.length(F.array_join("words_", "")).cast("long").alias("word_chars"),
        "n_symbols", (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), F.size("lines_").cast("long").alias("n_lines"), "n_upper")


def step(f: Feature) -> Column:
    return F.expr(f"CASE WHEN {f.below} > 0 THEN ({f.above} * {f.steps}) DIV {f.below} ELSE 0 END")


def fences(counted: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(lang, source, low_*, high_*): the fences of every language and source, from the finest level with enough documents.

    Only documents that pass the base rules are looked at. A null language or source is a group of its own.
    """
    values = counted.where("NOT base_failed").select("lang_", "source_", F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("feature"), step(f).alias("bin")) for f in FEATURES])).alias("v"))
    sketch = values.groupBy("lang_", "source_", "v.feature", "v.bin").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit("")
    levels = sketch.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("level"), lang.alias("lang_"), source.alias("source_"))
        for k, lang, source in ((0, F.col("lang_"), F.col("source_")), (1, F.col("lang_"), none), (2, none, none))])).alias("g"),
        "feature", "bin", "n")
    merged = levels.groupBy("g", "feature", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("g", "feature")
    summed = merged.withColumns({"total": F.sum("n").over(group),
                                 "upto": F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))})
    quartiles = summed.groupBy("g", "feature").agg(
        F.first("total").alias("total"), F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bin"))).alias("q3"))
    reach = f"{rules.fence} * (q3 - q1) + " + "CASE feature " + " ".join(f"WHEN '{f.name}' THEN {f.slack}" for f in FEATURES) + " END"
    each = quartiles.select("g", "total", "feature", F.expr(f"q1 - ({reach})").alias("low"), F.expr(f"q3 + {reach}").alias("high"))
    wide = each.groupBy("g").agg(F.first("total").alias("total"), *[
        F.max(F.when(F.col("feature") == f.name, F.col(side))).alias(f"{side}_{f.name}") for f in FEATURES for side in ("low", "high")])
    names = [f"{side}_{f.name}" for f in FEATURES for side in ("low", "high")]
    bound = F.struct(*names)

    def level(k: int) -> DataFrame:
        return wide.where((F.col("g.level") == k) & ((F.col("total") >= rules.min_group) | F.lit(k == 2)))

    fine = level(0).select(F.col("g.lang_").alias("lang_"), F.col("g.source_").alias("source_"), bound.alias("b0"))
    broad = level(1).select(F.col("g.lang_").alias("lang_"), bound.alias("b1"))
    whole = level(2).agg(F.first(F.struct(*names)).alias("b2"))
    groups = sketch.select("lang_", "source_").distinct()
    chosen = (groups.join(fine, ["lang_", "source_"], "left").join(broad, "lang_", "left")
              .join(F.broadcast(whole.withColumn("one", F.lit(1))), F.lit(1) == F.col("one"), "left"))         # one row
    return chosen.select("lang_", "source_", F.coalesce("b0", "b1", "b2").alias("b")).select("lang_", "source_", "b.*")


def quality_rules(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text", lang: str = "lang",
                  source: str = "source") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; one row per input row.

    A null or empty text has no words and fails the base rules. Null keys and repeated rows stay rows of their own; null
    languages and sources form a group; other columns are not read. A document that passes the base rules is kept when
    every feature lies inside the fences of its group. The text itself is never shuffled.
    """
    counted = counts(docs.select(F.col(key).alias("key_"), F.col(text).alias("text_"),
                                 F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang_"),
                                 F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source_")), "text_", ["key_", "lang_", "source_"])
    counted = counted.withColumn("base_failed", F.expr(
        f"n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words"))
    counted = stored(counted, "quality-counts")          # the sketches and the verdicts read it: texts are gone through once
    inside = F.lit(True)
    for f in FEATURES:
        inside = inside & (step(f) <= F.col(f"high_{f.name}"))
        if f.two_sided:
            inside = inside & (step(f) >= F.col(f"low_{f.name}"))
    return counted.join(stored(fences(counted, rules), "fences"), ["lang_", "source_"], "left").select(
        F.col("key_").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))
