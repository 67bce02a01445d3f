"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

All stages take whole texts of any length, empty tables (they give empty ones) and columns of any other name, which all but
the last hand on under their names. Null keys stay keys. What else may be odd is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, jaccard_join, line_dedup, packing, quality_model
from tidewire.llm.common import released, stored, table


def apart(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs under numbers, so that none can be taken for one that an operator put behind them."""
    n = len(docs.columns)
    return found.toDF(*[f"in{i}_" for i in range(n)], *found.columns[n:])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. Null and empty texts go; repeated rows share one verdict."""
    return apart(quality_model.scored(docs), docs).where("kept_").select(*released(docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay in one document; documents that consisted of nothing else go. n_chars follows the text.

    Null and empty texts lose nothing and stay. Rows equal in key and text lose the same.
    """
    cut = apart(line_dedup.line_dedup(docs), docs)
    text, size = (f"in{docs.columns.index(c)}_" for c in ("text", "n_chars"))
    left = cut.where((F.col("n_removed_") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    counted = F.when(F.col("n_removed_") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(size))
    return left.select(*released(docs.columns, {"n_chars": counted}))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest key; fully equal rows count as copies.

    Null texts and texts without words are linked with nothing and stay.
    """
    return jaccard_join.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null texts and texts without words stay; so does all if it is empty."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with the tokens themselves.

    Null and empty texts have the closing token alone; repeated rows and null keys are documents of their own. Workers live
    through all stages, so they remember fewer words here than where packing is all they do.
    """
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), kept=150_000, forget=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("line_dedup", lines), ("near_copies", near_copies), ("decontaminate", benchmark_free), ("packing", sequences),
]
#: A trained classifier and a curve over hashed vectors are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
