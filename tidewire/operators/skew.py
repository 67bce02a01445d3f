"""Keeping one heavy key from becoming one heavy task.

Three tools, none of which changes a result:

* `plan_cuts` splits the time line of each heavy conversation into chunks of about `chunk_rows` packets;
* `order_threshold` finds the k-th row of a total order from histograms instead of one global window.

What reaches the driver is planning data whose size is bounded by parameters, never by the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.schemas import FLOW_KEY

CHUNK_ROWS = 2_000_000      # packets of one conversation that one task may hold
MAX_CUTS = 100_000          # chunks in total; beyond that the chunks grow instead
SAMPLE_ROWS = 2_000_000     # rows looked at when placing the cuts
SMALL_ROWS = 200_000        # rows a table may have to be broadcast


def is_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> bool:
    """Does the table fit the broadcast bound? Reads at most max_rows + 1 rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    return F.broadcast(df) if is_small(df, max_rows) else df


def frozen(spark, rows: list, schema) -> DataFrame:
    """Bounded planning rows as a local table, so each use of them and each retry sees the same values."""
    return spark.createDataFrame(rows, schema)


@dataclass
class Cuts:
    """Places where heavy conversations are split: one row per heavy key, `cuts` ascending."""

    table: DataFrame
    most: int


def plan_cuts(
    keyed: DataFrame,
    chunk_rows: int = CHUNK_ROWS,
    max_cuts: int = MAX_CUTS,
    sample_rows: int = SAMPLE_ROWS,
) -> Cuts | None:
    """Cut points (ts_us, packet_seq) for conversations with more than about `chunk_rows` packets.

    A sample only decides where to cut; any cuts give the same flows. None when nothing is heavy.
    """
    total = keyed.count()
    if total <= chunk_rows:
        return None
    chunk_rows = max(chunk_rows, -(-total // max_cuts))
    fraction = min(1.0, sample_rows / total)
    sample = keyed.select(*FLOW_KEY, "ts_us", "packet_seq")
    if fraction < 1.0:
        sample = sample.sample(fraction, seed=7)
    step = max(1, int(chunk_rows * fraction))
    found = sample.groupBy(*FLOW_KEY).count().filter(F.col("count") > step).drop("count").collect()   # at most max_cuts keys
    if not found:
        return None
    keys = T.StructType([keyed.schema[c] for c in FLOW_KEY])
    heavy = frozen(keyed.sparkSession, [tuple(r) for r in found], keys)
    order = Window.partitionBy(*FLOW_KEY).orderBy("ts_us", "packet_seq")
    rows = (
        sample.join(F.broadcast(heavy), FLOW_KEY, "left_semi")
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") % step == 0)
        .groupBy(*FLOW_KEY)
        .agg(F.sort_array(F.collect_list(F.struct("ts_us", "packet_seq"))).alias("cuts"))
        .collect()      # bounded: at most max_cuts cut points in total
    )
    if not rows:
        return None
    schema = T.StructType(
        keys.fields
        + [T.StructField("cuts", T.ArrayType(T.StructType([
            T.StructField("ts_us", T.LongType()), T.StructField("packet_seq", T.LongType())])))]
    )
    table = frozen(keyed.sparkSession, [tuple(r) for r in rows], schema)
    return Cuts(table, max(len(r["cuts"]) for r in rows))


def count_at_most(sorted_array: Column, value: Column, longest: int) -> Column:
    """How many entries of a sorted array are <= value, by binary search."""
    steps = [1 << i for i in reversed(range(max(1, longest.bit_length())))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(sorted_array, at + step - 1) <= value, at + step).otherwise(at),
    )


def with_chunk(keyed: DataFrame, cuts: Cuts) -> DataFrame:
    """Adds `chunk`: 0 for ordinary conversations, the place on the cut time line for heavy ones."""
    at = count_at_most(F.col("cuts"), F.struct("ts_us", "packet_seq"), cuts.most)
    return (
        keyed.join(F.broadcast(cuts.table), FLOW_KEY, "left")   # bounded by max_cuts
        .withColumn("chunk", F.when(F.col("cuts").isNull(), 0).otherwise(at))
        .drop("cuts")
    )


def hash60(*columns) -> Column:
    """A 60-bit number from md5, the same in any engine; orders rows in a repeatable random way."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 15), 16, 10).cast("bigint")


@dataclass
class Threshold:
    """The first k rows of an order: rows before `values`, and `ties` of the `n_equal` rows equal to it."""

    values: tuple
    ties: int
    n_equal: int


HASH_RANGE = (0, (1 << 60) - 1)


def order_threshold(
    df: DataFrame, keys: list[str], k: int, ranges: dict[str, tuple[int, int]] = {}, bins: int = 1 << 14,
    few: int = 50_000,
) -> Threshold | None:
    """Finds the k-th row in the order of BIGINT columns `keys`, without sorting.

    Each round counts rows per bin of the remaining range (at most `bins` rows come back) and zooms into the
    bin that holds row k, until `few` rows or one value are left. None when k covers no row or all rows.
    """
    if k <= 0:
        return None
    # the rounds share the few bytes per row they need, so what makes the rows runs once
    kept = df if df.is_cached else df.select(*keys).persist()
    try:
        return _zoom(kept.select(*keys), keys, k, ranges, bins, few)
    finally:
        if kept is not df:
            kept.unpersist()


def _zoom(inside: DataFrame, keys: list[str], k: int, ranges: dict, bins: int, few: int) -> Threshold | None:
    at, left, n = [], k, None
    for key in keys:
        low, high = ranges.get(key) or inside.agg(F.min(key), F.max(key)).first()
        if low is None:
            return None
        while low < high or n is None:
            if n is not None and n <= few:
                return _threshold_of_few(inside, keys, at, left)
            width = max(1, -(-(high - low + 1) // bins))
            counts = (
                inside.groupBy(F.expr(f"({key} - ({low}L)) div {width}L").alias("bin")).count()
                .orderBy("bin").collect()
            )
            if left > sum(c for _, c in counts):
                return None
            for bin_no, n in counts:
                if left <= n:
                    break
                left -= n
            low, high = low + bin_no * width, min(high, low + (bin_no + 1) * width - 1)
            inside = inside.filter(F.col(key).between(low, high))
        at.append(low)
    return Threshold(tuple(at), left, n)


def _threshold_of_few(inside: DataFrame, keys: list[str], known: list[int], left: int) -> Threshold:
    rows = sorted(tuple(r) for r in inside.collect())       # bounded by `few`
    value = rows[left - 1]
    first = rows.index(value)
    return Threshold(value, left - first, rows.count(value))


def before(keys: list[str], values: tuple) -> Column:
    """Lexicographic `keys < values`."""
    test, equal = F.lit(False), F.lit(True)
    for key, value in zip(keys, values):
        test = test | (equal & (F.col(key) < F.lit(value)))
        equal = equal & (F.col(key) == F.lit(value))
    return test


def equal_to(keys: list[str], values: tuple) -> Column:
    test = F.lit(True)
    for key, value in zip(keys, values):
        test = test & (F.col(key) == F.lit(value))
    return test


def first_k(df: DataFrame, keys: list[str], k: int, ranges: dict[str, tuple[int, int]] = {}) -> tuple[Column, Threshold | None]:
    """A test for "among the first k in the order of `keys`"; with the threshold when copies straddle the cut."""
    if k <= 0:
        return F.lit(False), None
    cut = order_threshold(df, keys, k, ranges)
    if cut is None:
        return F.lit(True), None
    if cut.ties == cut.n_equal:
        return before(keys, cut.values) | equal_to(keys, cut.values), None
    return before(keys, cut.values), cut


def mark(df: DataFrame, tests: list[tuple[Column, Column, Threshold | None]], keys: list[str], name: str) -> DataFrame:
    """Adds a boolean from (where it applies, test, threshold) triples: one scan, unless copies straddle a cut.

    Rows that tie at the cut are told apart by all their columns; only full copies remain equal, and which of
    those is taken cannot be seen in the result. Copies are counted, not ranked one by one.
    """
    value = F.lit(None).cast("boolean")
    for where, test, _ in reversed(tests):
        value = F.when(where, test).otherwise(value)
    out = df.withColumn(name, value)
    for where, _, cut in tests:
        if cut is not None:
            tied = where & equal_to(keys, cut.values)
            out = out.filter(~tied).unionByName(_share_copies(df.filter(tied), cut.ties, name))
    return out


def mark_first(df: DataFrame, keys: list[str], k: int, name: str, ranges: dict[str, tuple[int, int]] = {}) -> DataFrame:
    """Adds a boolean: is the row among the first k in the order of `keys`? Exactly k rows are."""
    test, cut = first_k(df, keys, k, ranges)
    return mark(df, [(F.lit(True), test, cut)], keys, name)


def _share_copies(tied: DataFrame, k: int, name: str) -> DataFrame:
    """Marks k of the tied rows. Distinct rows are ranked; copies travel as a count and are laid out again."""
    columns = tied.columns
    counted = tied.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    # distinct rows with one and the same 60-bit hash: a handful, or one
    ranked = counted.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    taken = F.greatest(F.lit(0), F.least(F.col("_n"), F.lit(k) - F.col("_before")))
    parts = ranked.select(*columns, F.explode(F.array(
        F.struct(F.lit(True).alias(name), taken.cast("bigint").alias("_copies")),
        F.struct(F.lit(False).alias(name), (F.col("_n") - taken).cast("bigint").alias("_copies")),
    )).alias("_p")).select(*columns, "_p.*").filter("_copies > 0")
    block = 100_000
    blocks = parts.select(
        *columns, name,
        F.posexplode(F.sequence(F.lit(0), F.expr(f"(_copies - 1) div {block}"))).alias("_i", "_b"), "_copies",
    )
    # spread the blocks before writing the copies out, so that no task lays out a whole heavy group
    return (
        blocks.repartition(F.col("_b"), *[F.col(c) for c in columns[:1]])
        .withColumn("_m", F.least(F.lit(block), F.col("_copies") - F.col("_b") * block).cast("int"))
        .select(*columns, name, F.explode(F.array_repeat(F.lit(0), F.col("_m"))).alias("_x"))
        .drop("_x")
    )
