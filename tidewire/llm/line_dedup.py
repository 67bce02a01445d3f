"""Line dedup: content-defined chunks of lines, repeated chunks removed after their bytes are compared.

Line hashes roll over the text; where the hash of two neighbouring lines meets a condition, a chunk ends. The condition
depends on these lines alone, so inserted or removed lines move no border further away. Chunks are grouped by their bytes
over the whole corpus (copies combine before they are shuffled); of each repeated chunk the first document keeps its first
occurrence. Occurrences find their group by two hashes, and are compared byte by byte before they go.

Chunks miss what lies between their borders, so every pair of neighbouring lines that hold words is an anchor too: a pair that
occurred before is extended line by line in both directions as long as pairs did, and the stretch goes from `stretch` words on.
The first place of a line cannot lie in a pair that occurred before, so every line that goes is still there at its first place.
Pairs are told apart by two 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.scalar import bind
from tidewire.llm.common import held, released, stored

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Chunks:
    long_line: int = 25           # words from which a line is a chunk of its own
    one_in: int = 3               # elsewhere one border in so many, on average
    least: int = 25               # words of a chunk that may be removed
    stretch: int | None = None    # words of a stretch of repeated line pairs that may be removed; None: chunks only


#: What the query and the pipeline run with.
WHOLE = Chunks(stretch=25)


def chunked(docs: DataFrame, text: str, rules: Chunks) -> DataFrame:
    """docs and `chunks_`: an array of (k, a, w, t), the chunks of the text in order with their first line, words and bytes."""
    lined = bind(docs, {"lines_": F.split(F.col(text), "\n")})
    lined = bind(lined, {"hashes_": F.transform("lines_", lambda x: F.xxhash64(x)),
                         "counts_": F.transform("lines_", lambda x: F.regexp_count(x, F.lit(WORD)))})
    cut = bind(lined, {"cuts_": F.expr(f"""filter(CASE WHEN size(lines_) > 1 THEN sequence(1, size(lines_) - 1) ELSE array() END,
        i -> counts_[i - 1] >= {rules.long_line} OR counts_[i] >= {rules.long_line}
             OR pmod(xxhash64(hashes_[i - 1], hashes_[i]), {rules.one_in}) = 0)""")})
    ends = bind(cut, {"from_": F.expr("concat(array(0), cuts_)"), "to_": F.expr("concat(cuts_, array(size(lines_)))")})
    return bind(ends, {"chunks_": F.expr("""transform(from_, (a, k) -> struct(k AS k, a AS a,
        aggregate(slice(counts_, a + 1, to_[k] - a), 0, (s, x) -> s + x) AS w,
        array_join(slice(lines_, a + 1, to_[k] - a), '\n') AS t))""")}).drop("lines_", "hashes_", "counts_", "cuts_", "from_", "to_")


def worded(docs: DataFrame, text: str) -> DataFrame:
    """docs, and `lines_` of the text with their `counts_` of words, and `full_`: the places of those that hold any."""
    lined = bind(docs, {"lines_": F.split(F.col(text), "\n")})
    lined = bind(lined, {"counts_": F.transform("lines_", lambda x: F.regexp_count(x, F.lit(WORD)))})
    return bind(lined, {"full_": F.expr("filter(sequence(0, size(lines_) - 1), i -> counts_[i] > 0)")})


def repeated_pairs(rows: DataFrame) -> DataFrame:
    """(key_, mark_, pairs_): the pairs (j: of the lines j - 1 and j that hold words) of a text that are not there for the first time."""
    lined = worded(rows.where("t_ IS NOT NULL").select("key_", "mark_", "t_"), "t_").where("size(full_) > 1")
    paired = bind(lined, {"sorted_": F.expr("""sort_array(transform(sequence(1, size(full_) - 1), j -> struct(
        xxhash64(lines_[full_[j - 1]], lines_[full_[j]]) AS h, xxhash64(1, lines_[full_[j - 1]], lines_[full_[j]]) AS g, j AS j)))""")})
    places = paired.select("key_", "mark_", F.explode(F.transform("sorted_", lambda x, i: F.struct(
        x.h.alias("h"), x.g.alias("g"), x.j.alias("j"),
        F.coalesce((F.get("sorted_", i - 1).h == x.h) & (F.get("sorted_", i - 1).g == x.g), F.lit(False)).alias("again")))).alias("c"))
    places = stored(places.select("key_", "mark_", "c.*"), "line-pairs")
    groups = places.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min("key_").alias("first")).where("n > 1").drop("n")
    found = places.join(stored(groups, "pair-groups"), ["h", "g"]).where(F.col("again") | ~F.col("key_").eqNullSafe(F.col("first")))
    return found.groupBy("key_", "mark_").agg(F.sort_array(F.collect_set("j")).alias("pairs_"))


def line_dedup(docs: DataFrame, rules: Chunks = WHOLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs with repeated chunks cut out of the text, and n_chunks_, n_removed_ (long).

    A chunk of at least `least` words that occurs again, in the same document or another, stays only at its first place in
    the document with the smallest key; where rows share that key, each keeps its first. Null keys come after all others.
    So does each stretch of lines of at least `stretch` words in which no two neighbours stand together for the first time;
    blank lines are passed over, and go where they lie inside a stretch. n_removed_ counts chunks and stretches that went.
    A null text stays null (0 chunks), an empty one empty; a text that loses nothing is unchanged to the byte. Rows equal
    in key and text are one document and treated alike. Columns of any other name pass through.
    """
    names = docs.columns
    rows = held(docs, F.col(f"`{key}`").alias("key_"), F.col(f"`{text}`").cast("string").alias("t_"))
    rows = rows.withColumn("mark_", F.xxhash64("t_"))
    narrow = chunked(rows.where("t_ IS NOT NULL").select("key_", "mark_", "t_"), "t_", rules)
    heavy = narrow.select("key_", "mark_", F.filter("chunks_", lambda c: c.w >= rules.least).alias("chunks_"))
    groups = (heavy.select("key_", F.explode("chunks_.t").alias("t")).groupBy("t")
              .agg(F.count(F.lit(1)).alias("n"), F.min("key_").alias("first"))
              .where("n > 1").select(F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("g"), "t", "first"))
    groups = stored(groups, "line-groups")
    placed = bind(heavy, {"sorted_": F.sort_array(F.transform("chunks_", lambda c: F.struct(
        F.xxhash64(c.t).alias("h"), F.xxhash64(F.lit(1), c.t).alias("g"), c.k.alias("k"))))})
    places = placed.select("key_", "mark_", F.explode(F.transform("sorted_", lambda x, i: F.struct(
        x.h.alias("h"), x.g.alias("g"), x.k.alias("k"),
        F.coalesce((F.get("sorted_", i - 1).h == x.h) & (F.get("sorted_", i - 1).g == x.g), F.lit(False)).alias("again")))).alias("c"))
    found = (places.select("key_", "mark_", "c.*").join(groups, ["h", "g"])
             .where(F.col("again") | ~F.col("key_").eqNullSafe(F.col("first"))))
    gone = found.groupBy("key_", "mark_").agg(F.collect_list(F.struct("k", "t")).alias("gone_"))
    if rules.stretch is not None:
        pairs = repeated_pairs(rows)
        both = gone.withColumn("pairs_", F.lit(None).cast("array<int>")).unionByName(
            pairs.withColumn("gone_", F.lit(None).cast(gone.schema["gone_"].dataType)))
        gone = both.groupBy("key_", "mark_").agg(F.flatten(F.collect_list("gone_")).alias("gone_"), F.flatten(F.collect_list("pairs_")).alias("pairs_"))
    else:
        gone = gone.withColumn("pairs_", F.array().cast("array<int>"))
    gone = gone.withColumnsRenamed({"key_": "key2_", "mark_": "mark2_"})
    joined = rows.join(gone, (F.col("mark_") == F.col("mark2_")) & F.col("key_").eqNullSafe(F.col("key2_")), "left")
    again = chunked(joined, "t_", rules)
    checked = bind(again, {"k_": F.transform(F.filter("gone_", lambda x: F.get("chunks_", x.k).t == x.t), lambda x: x.k)})
    lined = worded(checked, "t_")
    # the pairs in a row make a run of lines; its first and last place among all lines
    runs = bind(lined, {"runs_": F.expr("""zip_with(
        filter(pairs_, (j, i) -> i = 0 OR get(pairs_, i - 1) <> j - 1), filter(pairs_, (j, i) -> coalesce(get(pairs_, i + 1) <> j + 1, true)),
        (x, y) -> struct(full_[x - 1] AS a, full_[y] AS b))""")})
    long = bind(runs, {"stretches_": F.expr(f"""filter(runs_, r ->
        aggregate(slice(counts_, r.a + 1, r.b - r.a + 1), 0, (s, x) -> s + x) >= {rules.stretch or 0})""")})
    left = F.expr("""transform(array_except(sequence(0, size(lines_) - 1), concat(
        flatten(transform(k_, k -> sequence(get(chunks_, k).a, coalesce(get(chunks_, k + 1).a, size(lines_)) - 1))),
        flatten(transform(stretches_, r -> sequence(r.a, r.b))))), i -> get(lines_, i))""")
    number = F.coalesce(F.greatest(F.size("k_"), F.lit(0)) + F.greatest(F.size("stretches_"), F.lit(0)), F.lit(0))
    cut = F.when(F.col("gone_").isNull() | (number == 0), F.col("t_")).otherwise(F.array_join(left, "\n"))
    kind = docs.schema[text].dataType
    return long.select(*released(names, {text: cut.cast(kind)}),
                       F.coalesce(F.greatest(F.size("chunks_"), F.lit(0)), F.lit(0)).cast("long").alias("n_chunks_"), number.cast("long").alias("n_removed_"))
