"""Benchmark decontamination: a broadcast hash set of test windows against every window of every training text.

Words and windows are arrays inside the row; a window's hash is looked up in the set of all test window hashes, and only
hits leave the row, with their words, to be verified against the test window itself. Documents are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.scalar import bind
from tidewire.llm.common import held, released

#: What lies between words: ASCII characters other than digits and letters (upper-case letters are lowered before).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Test windows that are looked up inside the row. Beyond, windows of all texts are joined to them by a shuffle.
MAX_SET = 200_000


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), GAP), "")


def windows_of(items: DataFrame, size: int, item: str, text: str) -> DataFrame:
    """(h, w, l, items): each distinct test window with its length and the ids (text) of all items that hold it.

    An item of fewer words than `size` is one window; one without words has none. A null id is written as ''.
    """
    worded = bind(items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")),
                  {"words": words_of(F.col("text"))}).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(size))
    cut = worded.select("item", length.alias("l"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.slice("words", i, length))).alias("cut"))
    return (cut.groupBy(F.xxhash64("cut").alias("h"), F.array_join("cut", " ").alias("w"), "l")
            .agg(F.collect_set("item").alias("items")))


def hits_in_row(lengths: list[int], hashes: list[int] | None) -> Column:
    """Of the bound column `words`: place (from 1), length, hash and words of windows whose hash is in the set (None: all)."""
    wanted = "" if hashes is None else f" AND xxhash64(slice(words, i, {{n}})) IN ({', '.join(f'{h}L' for h in hashes)})"
    shape = ("transform(filter(CASE WHEN size(words) >= {n} THEN sequence(1, size(words) - {n} + 1) ELSE array() END, "
             f"i -> i > 0{wanted}), "
             "i -> struct(i AS p, {n} AS l, xxhash64(slice(words, i, {n})) AS h, array_join(slice(words, i, {n}), ' ') AS w))")
    return F.expr(f"concat({', '.join(shape.format(n=n) for n in lengths)})")


class TestSet:
    """The windows of all test items, as a small table and, where they are few enough, as a set of hashes."""

    __test__ = False

    def __init__(self, items: DataFrame, size: int = 10, item: str = "item_id", text: str = "text", most: int = MAX_SET):
        self.windows = windows_of(items, size, item, text)
        self.lengths = sorted(r.l for r in self.windows.select("l").distinct().collect())        # at most `size` numbers
        found = self.windows.select("h").distinct().limit(most + 1).collect()
        self.hashes = [r.h for r in found] if len(found) <= most else None

    def hits(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """keep, words, p, l, items: one row per verified window of a text, or one with nulls where a text has none."""
        worded = bind(docs.withColumn("row", F.monotonically_increasing_id()), {"words": words_of(F.col("text"))})
        if not self.lengths:
            return worded.select("row", *keep, F.size("words").alias("n_words"), F.lit(None).cast("int").alias("p"),
                                 F.lit(None).cast("int").alias("l"), F.lit(None).cast("array<string>").alias("items"))
        found = worded.select("row", *keep, F.size("words").alias("n_words"),
                              F.explode_outer(hits_in_row(self.lengths, self.hashes)).alias("hit"))
        found = found.select("row", *keep, "n_words", F.col("hit.p").alias("p"), F.col("hit.h").alias("h"), F.col("hit.w").alias("w"))
        windows = self.windows if self.hashes is None else F.broadcast(self.windows)
        return found.join(windows, ["h", "w"], "left").select("row", *keep, "n_words", "p", "l", "items")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", most: int = MAX_SET) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items_sha256, contaminated, spans (word places hit, from 0, ascending).

    A word is hit if it lies in any occurrence of a test window (`size` consecutive words of an item, all of a shorter
    item). One row per input row: null texts and texts without words have 0 words; null keys and repeated rows are kept
    apart by row; other columns are not read. Without test items nothing is hit.
    """
    tests = TestSet(items, size, item, item_text, most)
    found = tests.hits(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), ["key"])
    grouped = found.groupBy("row", "key", "n_words").agg(
        F.collect_list(F.when(F.col("l").isNotNull(), F.struct("p", "l"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("ids"))
    spans = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x.p - 1, x.p + x.l - 2)))))
    return bind(grouped, {"spans": spans}).select(
        F.col("key").alias(key), F.col("n_words").cast("long").alias("n_words"), F.size("spans").cast("long").alias("n_hit"),
        F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "spans")


def remove_documents(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text", item_text: str = "text",
                     most: int = MAX_SET) -> DataFrame:
    """The documents that hold no test window, with all their columns; clashing column names do not matter.

    Null texts and texts without words stay. Within the bound on test windows the verdict is made inside the row, by hash
    and then by the words themselves, without any shuffle; beyond it by a join.
    """
    out = docs.columns
    tests = TestSet(items, size, "item_id" if "item_id" in items.columns else item_text, item_text, most)
    if not tests.lengths:
        return docs
    row = held(docs, F.col(f"`{text}`").alias("text"))
    keep = row.columns[:-1]
    if tests.hashes is None:
        # the row's own number is not repeatable over two reads: carry the row through the join
        clean = tests.hits(row, keep).groupBy("row").agg(F.max(F.col("l").isNotNull()).alias("bad"), *[F.first(c).alias(c) for c in keep])
        return clean.where(~F.col("bad")).select(*released(out))
    texts = [r.w for r in tests.windows.select("w").distinct().collect()]
    known = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in texts)
    worded = bind(row, {"words": words_of(F.col("text"))})
    found = bind(worded, {"hits": hits_in_row(tests.lengths, tests.hashes)})
    return found.where(~F.expr(f"exists(hits, x -> x.w IN ({known}))")).select(*released(out))


def remove_spans(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text", item_text: str = "text") -> DataFrame:
    """All documents, with every word that a test window covers cut out of the text (what stands between words stays)."""
    out = docs.columns
    tests = TestSet(items, size, "item_id" if "item_id" in items.columns else item_text, item_text)
    if not tests.lengths:
        return docs
    row = held(docs, F.col(f"`{text}`").cast("string").alias("text"))
    hit = (tests.hits(row, row.columns).groupBy("row").agg(
        *[F.first(c).alias(c) for c in row.columns],
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("l").isNotNull(), F.sequence(F.col("p") - 1, F.col("p") + F.col("l") - 2)))))
        .alias("gone")))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    parts = bind(hit, {"kept": F.regexp_extract_all("text", F.lit(f"({word})"), 1), "gaps": F.split("text", word)})
    cut = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.concat(
        F.array_join(F.zip_with(F.slice("gaps", 1, F.size("kept")), F.transform("kept", lambda w, i: F.when(
            F.array_contains("gone", i), F.lit("")).otherwise(w)), lambda g, w: F.concat(g, w)), ""),
        F.element_at("gaps", -1)))
    return parts.select(*released(out, {text: cut}))
