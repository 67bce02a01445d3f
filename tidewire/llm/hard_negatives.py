"""Hard negatives found in a multiway hyperplane tree whose split points store the ranges of their distances to all siblings.

The tree (GNAT) is grown on a bounded sample: a node has up to 16 split points far apart, and a vector belongs to the child of
the split point nearest to it. All vectors are routed to leaves. For each pair of a split point and a child of the same node
the least and the largest distance between the point and the child's vectors are kept, over all vectors, and the range of the
child's norms. A window of inner products with an anchor, [low, high], is an annulus around it for vectors of a known range
of norms: |a - x|^2 = |a|^2 + |x|^2 - 2 a.x. By the triangle inequality a split point at distance d from the anchor rules a
child out when the child's range does not meet [max(d - outer, inner - d), d + outer].

Two searches: positives (any inner product above the fifth best that the anchor's own leaf holds), then negatives (the windows
that the positives set). Anchors travel to blocks of the leaves that are left, and meet all of the block's vectors in exact
whole numbers. A task holds one block and streams its anchors; blocks are bounded, whatever the leaves hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.llm.common import partitions, release, stored
from tidewire.llm.vector_codes import finite, matrix, whole, wide

SCALE, FANOUT, LEAF_ROWS, BLOCK_ROWS = 256, 16, 512, 4096
#: Vectors the tree is grown on; it has a leaf for four of them at most.
SAMPLE = 4096
#: Inner products up to here are exact in floats.
EXACT = 1 << 53


@dataclass
class Node:
    """Split points; below[j] is a node or the number of a leaf. Ranges are squared distances, filled in by `measured`."""

    number: int
    points: np.ndarray
    below: list["Node | int"]
    low: np.ndarray = field(default=None)
    high: np.ndarray = field(default=None)
    norm_low: np.ndarray = field(default=None)
    norm_high: np.ndarray = field(default=None)


def squares(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of rows to points, exact."""
    return np.stack([((x - p) ** 2).sum(1) for p in points], 1)


def grow(sample: np.ndarray, leaves: int, fanout: int = FANOUT) -> tuple[Node | int, int, list[Node]]:
    """(root, number of leaves, nodes). Split points are chosen far apart: each next one is farthest from those before it."""
    nodes: list[Node] = []
    count = 0

    def build(x: np.ndarray, share: int) -> Node | int:
        nonlocal count
        if share <= 1 or len(np.unique(x, axis=0)) < 2:
            count += 1
            return count - 1
        points = [x[0]]
        near = ((x - x[0]) ** 2).sum(1)
        while len(points) < min(share, fanout) and near.max() > 0:
            points.append(x[int(near.argmax())])
            near = np.minimum(near, ((x - points[-1]) ** 2).sum(1))
        node = Node(len(nodes), np.stack(points), [])
        nodes.append(node)
        side = squares(x, node.points).argmin(1)
        for j in range(len(points)):
            part = x[side == j]
            node.below.append(build(part, min(round(share * len(part) / len(x)), len(part) // 4)))
        return node

    root = build(sample, leaves)
    return root, count, nodes


def route(x: np.ndarray, root: Node | int, visit: Callable[[Node, np.ndarray, np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
    """The leaf of each row; `visit` sees (node, rows, squared distances to its points, chosen child)."""
    leaf = np.zeros(len(x), np.int32)

    def go(node: Node | int, rows: np.ndarray) -> None:
        if not isinstance(node, Node):
            leaf[rows] = node
            return
        d = squares(x[rows], node.points)
        side = d.argmin(1)                                              # ties to the lower point
        if visit:
            visit(node, rows, d, side)
        for j in np.unique(side):
            go(node.below[j], rows[side == j])

    if len(x):
        go(root, np.arange(len(x)))
    return leaf


def surviving(q: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, root: Node | int, leaves: int) -> np.ndarray:
    """[row, leaf]: whether a leaf may hold a vector whose inner product with the row lies in one of its windows.

    low and high are [row, window] floats; a window with low > high is none, infinities are open ends.
    """
    found = np.zeros((len(q), leaves), bool)

    def go(node: Node | int, rows: np.ndarray) -> None:
        if not isinstance(node, Node):
            found[rows, node] = True
            return
        d = np.sqrt(squares(q[rows], node.points).astype(float))
        room = 1e-6 * (1 + d.max(1, initial=0))[:, None]
        alive = np.zeros((len(rows), len(node.below)), bool)
        for w in range(low.shape[1]):
            lo, hi = low[rows, w, None], high[rows, w, None]
            outer2 = norms[rows, None] + node.norm_high - 2 * lo
            inner2 = norms[rows, None] + node.norm_low - 2 * hi
            open_ = (lo <= hi) & (outer2 >= 0) & (node.norm_low <= node.norm_high)
            outer, inner = np.sqrt(np.maximum(outer2, 0)) + room, np.sqrt(np.maximum(inner2, 0)) - room
            for i in range(len(node.points)):
                di = d[:, i, None]
                open_ &= (node.high[i] >= np.maximum(di - outer, inner - di)) & (node.low[i] <= di + outer)
            alive |= open_
        for j in np.flatnonzero(alive.any(0)):
            go(node.below[j], rows[alive[:, j]])

    if len(q):
        go(root, np.arange(len(q)))
    return found


def indexed(rows: DataFrame, sample: int, leaf_rows: int, block_rows: int) -> tuple[DataFrame, Node | int, dict[int, tuple[int, int]]] | None:
    """(rows with leaf and block, root with its ranges, {leaf: (first block, blocks)}); None for an empty table.

    A leaf of many rows is dealt into blocks by a hash of the row's number.
    """
    total = rows.count()
    taken = [r["q"] for r in rows.select("q", F.xxhash64("row").alias("h"), "row").orderBy("h", "row").limit(sample).collect()]
    if not total:
        return None
    width = len(taken[0])
    if any(len(q) != width for q in taken):
        raise ValueError(f"vectors of unlike lengths, {width} and others")
    root, leaves, nodes = grow(np.array(taken, np.int64), min(-(-total // leaf_rows), max(1, len(taken) // 4)))
    kinds = {f.name: to_arrow_type(f.dataType) for f in rows.schema.fields}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = wide(batch.column(batch.schema.get_field_index("q")), width)
            if int(np.abs(x).max()) ** 2 * width >= EXACT:
                raise ValueError("components are too large for exact products")
            yield pa.RecordBatch.from_arrays([*(c.cast(kinds[n]) for n, c in zip(batch.schema.names, batch.columns)), pa.array(route(x, root))], [*batch.schema.names, "leaf"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    routed = stored(rows.mapInArrow(place, f"{schema}, leaf int"), "routed")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, i, j, low, high) of a task's rows; i = -1 for the norms of child j."""
        low: dict[tuple[int, int, int], int] = {}
        high: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            x = matrix(batch.column(0))
            norm = (x ** 2).sum(1)

            def seen(node: Node, rows: np.ndarray, d: np.ndarray, side: np.ndarray) -> None:
                for j in np.unique(side).tolist():
                    part = np.column_stack([norm[rows[side == j]], d[side == j]])
                    for i, (a, b) in enumerate(zip(part.min(0).tolist(), part.max(0).tolist()), -1):
                        at = (node.number, i, j)
                        low[at], high[at] = min(a, low.get(at, a)), max(b, high.get(at, b))

            route(x, root, seen)
        if low:
            node, i, j = (pa.array(c, pa.int32()) for c in zip(*low))
            yield pa.RecordBatch.from_arrays([node, i, j, pa.array(low.values(), pa.int64()), pa.array([high[k] for k in low], pa.int64())], ["node", "i", "j", "low", "high"])

    for node in nodes:
        shape = node.points.shape[0]
        node.low, node.high = np.full((shape, shape), np.inf), np.full((shape, shape), -np.inf)
        node.norm_low, node.norm_high = np.full(shape, np.inf), np.full(shape, -np.inf)
    ranges = routed.select("q").mapInArrow(measure, "node int, i int, j int, low long, high long").groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for n, i, j, a, b in ranges.collect():                               # at most 17 a child
        if i < 0:
            nodes[n].norm_low[j], nodes[n].norm_high[j] = a, b
        else:
            nodes[n].low[i, j], nodes[n].high[i, j] = np.sqrt(a) * (1 - 1e-9), np.sqrt(b) * (1 + 1e-9)
    counts = dict(routed.groupBy("leaf").count().collect())              # a row a leaf
    blocks, before = {}, 0
    for leaf in range(leaves):
        n = -(-counts.get(leaf, 0) // block_rows)
        blocks[leaf] = (before, n)
        before += n
    table = F.broadcast(rows.sparkSession.createDataFrame([(k, a, n) for k, (a, n) in blocks.items() if n], "leaf int, first int, blocks int"))     # at most SAMPLE / 4 rows
    return routed.join(table, "leaf").withColumn("block", F.col("first") + F.pmod(F.xxhash64("row"), "blocks").cast("int")).drop("first", "blocks"), root, blocks


def visits(queries: DataFrame, windows: str, root: Node | int, blocks: dict[int, tuple[int, int]]) -> DataFrame:
    """The queries (row, label, q, `windows`: list of low, high, ...) once for each block that may hold what they look for."""
    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, 256):
                batch = whole_batch.slice(a, 256)
                q, bounds = matrix(batch.column(2)), matrix(batch.column(3), float)
                alive = surviving(q, (q ** 2).sum(1).astype(float), bounds[:, ::2], bounds[:, 1::2], root, len(blocks))
                go = [[b for leaf in np.flatnonzero(x).tolist() for b in range(blocks[leaf][0], sum(blocks[leaf]))] for x in alive]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(go, pa.list_(pa.int32()))], ["row", "label", "q", "bounds", "go"])

    picked = queries.select("row", "label", "q", F.col(windows).alias("bounds"))
    found = picked.mapInArrow(plan, "row long, label long, q array<long>, bounds array<double>, go array<int>")
    return found.select("row", "label", "q", "bounds", F.explode("go").alias("block"))


def met(index: DataFrame, asking: DataFrame, same: bool, most: int) -> DataFrame:
    """(row, window, found, score): for each query and window the best `most` rows of its blocks, of the same label or others.

    `found` is the number of the row that was found; a query never finds itself. Equal scores: the smaller key (as `rank` of
    the index says), then the smaller number.
    """
    none = F.lit(None).cast("array<double>")
    both = index.select("block", F.lit(0).alias("side"), "row", "label", "rank", "q", none.alias("bounds")).unionByName(
        asking.select("block", F.lit(1).alias("side"), "row", "label", F.lit(0).cast("long").alias("rank"), "q", "bounds"))
    parts = partitions(index.sparkSession)
    dealt = both.repartitionById(parts, F.pmod("block", F.lit(parts))).sortWithinPartitions("block", "side")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pieces, held = None, [], None
        for whole_batch in batches:
            marks = whole_batch.column(0).to_numpy() * 2 + whole_batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), whole_batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                at, asks = divmod(int(marks[a]), 2)
                if at != block:
                    block, pieces, held = at, [], None
                run = whole_batch.slice(a, b - a)
                if not asks:
                    pieces.append([run.column(i).to_numpy() for i in (2, 3, 4)] + [matrix(run.column(5), np.float64)])
                    continue
                if held is None and pieces:
                    held = [np.concatenate(c) for c in zip(*pieces)]
                    order = np.lexsort((held[0], held[2]))               # ties in the order they are to come in
                    held, pieces = [c[order] for c in held], []
                for start in range(0, run.num_rows, 128):
                    out = best(held, run.slice(start, 128), same, most)
                    if out is not None:
                        yield out
        release()

    return dealt.mapInArrow(scan, "row long, window int, found long, score long, rank long")


def best(held: list[np.ndarray], asks: pa.RecordBatch, same: bool, most: int) -> pa.RecordBatch | None:
    rows, labels, ranks, x = held
    own, label, bounds = asks.column(2).to_numpy(), asks.column(3).to_numpy(), matrix(asks.column(6), np.float64)
    scores = matrix(asks.column(5), np.float64) @ x.T
    out: list[tuple[np.ndarray, ...]] = []
    for n in range(len(own)):
        low, high = bounds[n, ::2], bounds[n, 1::2]
        windows = np.flatnonzero(low <= high)
        if not len(windows):
            continue
        fits = (labels == label[n]) == same
        fits &= (scores[n] >= low[windows].min()) & (scores[n] <= high[windows].max()) & (rows != own[n])
        at = np.flatnonzero(fits)
        at = at[np.argsort(-scores[n, at], kind="stable")]
        s = -scores[n, at]
        for w in windows.tolist():
            first, end = np.searchsorted(s, -high[w], "left"), np.searchsorted(s, -low[w], "right")
            pick = at[first:min(end, first + most)]
            if len(pick):
                out.append((np.full(len(pick), own[n]), np.full(len(pick), w, np.int32), rows[pick], scores[n, pick].astype(np.int64), ranks[pick]))
    if not out:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["row", "window", "found", "score", "rank"])


def top(found: DataFrame, most: int) -> DataFrame:
    """The best of all blocks, numbered from 1."""
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "rank", "found")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def hard_negatives(vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5,
                   percent: int = 80, scale: int = SCALE, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor, positive and negative.

    Rows with a null label, or a vector that is null, empty or holds null or non-finite components take no part. Components
    become floor(scale * x); a score is the whole inner product with the anchor. `anchors` says, by the columns of the table,
    which rows are anchors. Its positives are the first rows of its label by score, then key (null keys last, then in the
    order they were read), itself left out; for each positive the first rows of other labels with percent/100 of the
    positive's score at least, and no more than the score itself, are returned, ranked from 1. Rows that share a key are rows
    of their own. A row without positives, or a positive without negatives, gives no row. An empty table gives none. Labels are
    whole numbers, and so are keys. Vectors of unlike lengths and products beyond 2^53 are refused with a ValueError.
    The tree is grown on `sample` rows; all rows are indexed and results are exact.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    names = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
    usable = vectors.where(finite(f"`{vector}`") & F.col(f"`{label}`").cast("long").isNotNull())
    rows = usable.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("long").alias("label"), whole(f"`{vector}`", scale).alias("q"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("keys are whole numbers")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    ranked = rows.withColumn("rank", F.coalesce(F.col("key").cast("long"), F.lit((1 << 63) - 1)))
    built = indexed(ranked.drop("key"), sample, leaf_rows, block_rows)
    if built is None:
        return spark.createDataFrame([], names)
    index, root, blocks = built
    index = stored(index, "index")
    asking = index.where("anchor")
    everything = F.array(F.lit(float("-inf")), F.lit(float("inf")))

    # the fifth best of the own block bounds the positives from below
    own = met(index, asking.select("block", "row", "label", "q", everything.alias("bounds")), True, positives)
    floors = top(own, positives).where(F.col("place") == positives).select("row", F.col("score").cast("double").alias("floor"))
    queries = asking.join(floors, "row", "left").withColumn("bounds", F.array(F.coalesce("floor", F.lit(float("-inf"))), F.lit(float("inf"))))
    good = stored(top(met(index, visits(queries, "bounds", root, blocks), True, positives), positives), "positives")

    low = F.when(F.col("score") >= 0, F.floor((F.col("score") * percent + 99) / 100)).otherwise(F.lit(1)).cast("double")
    high = F.when(F.col("score") >= 0, F.col("score")).otherwise(F.lit(0)).cast("double")              # below 0 no score fits
    window = good.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct(low.alias("low"), high.alias("high"))))).alias("w"))
    places = F.sequence(F.lit(1), F.lit(positives))
    windows = window.select("row", F.flatten(F.transform(places, lambda p: F.coalesce(F.array(F.col("w")[p]["low"], F.col("w")[p]["high"]), F.array(F.lit(1.0), F.lit(0.0))))).alias("bounds"))
    windows = windows.withColumn("bounds", F.transform("bounds", lambda x, i: F.coalesce(x, F.when(i % 2 == 0, 1.0).otherwise(0.0))))
    bad = top(met(index, visits(asking.join(windows, "row"), "bounds", root, blocks), False, negatives), negatives)

    found = bad.select("row", (F.col("window") + 1).alias("place"), F.col("found").alias("bad"), F.col("score").alias("negative_score"), F.col("place").alias("rank"))
    found = found.join(good.select("row", "place", F.col("found").alias("good"), F.col("score").alias("positive_score")), ["row", "place"])
    ids = rows.select("row", "key")
    for column, name in (("row", "anchor_id"), ("good", "positive_id"), ("bad", "negative_id")):
        found = found.join(ids.select(F.col("row").alias(column), F.col("key").alias(name)), column)
    return found.select(*[F.col(c.split()[0]) for c in names.split(", ")])
