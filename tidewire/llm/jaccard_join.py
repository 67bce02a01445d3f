"""Exact Jaccard join of word-shingle sets by partitioning the universe of shingles.

Two sets of sizes s and t with J >= 3/4 differ in at most h = (s + t) / 7 elements. The universe is hashed into m segments;
m depends on the band of h. With m > h segments at least m - h of them are equal in both sets, so the sets meet under the
signature of one of them. Small sets take half as many segments and also file each one under all its one-deletion
neighbours, which finds segments that differ in one element. Where that is cheaper is decided by the number and the length
of the signatures (`bands`).

Empty segments are not filed. How often a set is certain to meet any linked one follows from its own segments (`certain`):
each element of difference spoils a segment at most; with neighbours it takes two, or one where the segment holds a single
element. m is a quarter larger than need be, so that this is well above 1 for all but a few small sets, whose elements fall
into few segments. Those also file the elements of their prefix, a quarter of them and one in the order of their hashes: two
linked sets share one (prefix filtering), so two such sets meet there.

A set can do without as many of its certain meetings, less one, and spends this allowance on the costliest, those that most
other sets share; who meets less often than that bound is no candidate at all. Candidates are verified on whole texts.

Copies (equal sets) are one class from the start. Every class first compares itself with one other, of those it meets the
one with most meetings in all (of a group of near copies, the one they stem from); after that only classes of different
components are compared, so large groups of near copies never expand into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import held, partitions, release, released, slices, stored
from tidewire.llm.components import components, pointer_roots
from tidewire.llm.shingles import forget, mix, set_id, shingle_set

#: Sets of at most this difference file one-deletion neighbours.
SHORT = 18
#: Bits that stand for a set where very many are compared; members of a bucket compared in one task.
PARITIES, BLOCK = 2048, 1024
#: Ids looked up by broadcast; more are joined by a shuffle.
MOST_SENT = 1_000_000
#: Signatures a task gathers before it hands them on.
GATHERED = 1_000_000


def bands(largest: int = 1 << 40) -> list[tuple[int, int, int]]:
    """(largest difference, segments, differences a segment may hold) of each band; sets differing in 0 elements are copies."""
    found, h = [], 1
    while h < largest:
        v = 2 if h <= SHORT else 1
        found.append((h, -(-8 * (h + 1) // (5 * v)), v))
        h = h + 1 if h < 3 else 2 * h
    return found


BANDS = bands()
TOPS = np.array([b[0] for b in BANDS])


def bands_of(n: int) -> range:
    """The bands in which a set of n elements may have a partner."""
    low, high = (n + -(-3 * n // 4)) // 7, (n + 4 * n // 3) // 7
    return range(int(np.searchsorted(TOPS, max(low, 1))), int(np.searchsorted(TOPS, high)) + 1) if high else range(0)


def certain(n: int, filled: int, single: int, band: int) -> int:
    """The signatures that a set of n elements is certain to share with any set it links with in this band, by its segments alone.

    `filled` of them hold anything, `single` a single element.
    """
    top, _, v = BANDS[band]
    apart = min((n + 4 * n // 3) // 7, top)
    if v == 1:
        return max(0, filled - apart)
    lost = min(single, apart)
    return max(0, filled - lost - min((apart - lost) // 2, filled - single))


def signatures(hashes: np.ndarray, band: int) -> tuple[np.ndarray, int]:
    """Signatures of the segments that hold anything (with neighbours where the band has them), and how many are certain to be shared.

    Where none is, the elements of the prefix are added.
    """
    _, m, v = BANDS[band]
    segment = (hashes >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
    start = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    own = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    total = np.add.reduceat(own, start)
    salt = mix(segment * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1))
    found = mix(total + salt[start])
    size = np.diff(np.append(start, len(hashes)))
    if v == 2:
        less = np.repeat(total, size) - own
        alone = np.repeat(size, size) == 1                      # what is left would be the empty segment
        found = np.concatenate([found, mix(less + salt)[~alone]])
    sure = certain(len(hashes), len(start), int((size == 1).sum()), band)
    if not sure:
        found = np.concatenate([found, mix(own[:len(hashes) // 4 + 1] ^ np.uint64(0xD1B54A32D192ED03) + np.uint64(band + 1))])
    return found, sure


def parities(hashes: np.ndarray) -> bytes:
    count = np.bincount((hashes & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES)
    return np.packbits(count & 1).tobytes()


def set_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mark, n, cls, bits): the size and class of every row's set; mark is a hash of the text. Empty sets have no class.

    bits holds 2048 parities: bit b says whether the set has an odd number of elements that hash to b. Two sets differ in at
    least as many elements as their parities do.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [shingle_set(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(map(len, sets), pa.int64()),
                 pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array(map(parities, sets), pa.binary())],
                ["key", "mark", "n", "cls", "bits"])
        forget()

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("mark")).mapInArrow(
        run, f"key {kind}, mark long, n long, cls long, bits binary")


def filed(docs: DataFrame, text: str, parts: int) -> DataFrame:
    """Signatures, packed: a row for each part and flush, with the classes they belong to. A task files each set once."""
    entry = np.dtype([("cls", "<i8"), ("n", "<u4"), ("sure", "<u4"), ("band", "u1")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        found: list[np.ndarray] = []
        entries: list[tuple[int, int, int, int]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            sig = np.concatenate(found)
            owner = np.repeat(np.arange(len(found), dtype=np.int64), [len(f) for f in found])
            part = (sig >> np.uint64(40)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            sig, owner, part = sig[order], owner[order], part[order]
            table = np.array(entries, entry)
            start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            rows: list[tuple] = []
            for a, b in zip(start, np.append(start[1:], len(part))):
                used, place = np.unique(owner[a:b], return_inverse=True)
                low = sig[a:b] & np.uint64(0xFFFFFFFFFF)
                rows.append((int(part[a]), b - a, (low & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (low >> np.uint64(32)).astype("u1").tobytes()
                             + place.astype("<u2").tobytes(), table[used].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                                              ["part", "n", "sigs", "entries"])

        for batch in slices(batches, "text"):
            for value in batch.column(0).to_pylist():
                hashes = shingle_set(value)
                if not len(hashes) or (cls := set_id(hashes)) in seen:
                    continue
                seen.add(cls)
                for band in bands_of(len(hashes)):
                    sig, sure = signatures(hashes, band)
                    found.append(sig)
                    entries.append((cls, len(hashes), sure, band))
                    total += len(sig)
                if total >= GATHERED or len(entries) >= 60_000:
                    yield flush()
                    found, entries, total = [], [], 0
        if total:
            yield flush()
        forget()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "part int, n int, sigs binary, entries binary")


def meetings(packed: DataFrame, parts: int) -> DataFrame:
    """(bucket, weight, shared, band, cls, n, sure): who meets under one signature.

    One row per class and list of classes; a list that occurs under several signatures of a part is kept once, with their
    number as weight. `shared` is the length of the list.
    """
    entry = np.dtype([("cls", "<i8"), ("n", "<u4"), ("sure", "<u4"), ("band", "u1")])
    schema = "bucket long, weight int, shared int, band int, cls long, n long, sure int"
    names = [c.split()[0] for c in schema.split(", ")]

    def find(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sigs, owners, tables, base = [], [], [], 0
        for n, sig, table in rows:
            low = np.frombuffer(sig, "<u4", n).astype(np.uint64) | np.frombuffer(sig, "u1", n, 4 * n).astype(np.uint64) << np.uint64(32)
            table = np.frombuffer(table, entry)
            sigs.append(low)
            owners.append(np.frombuffer(sig, "<u2", n, 5 * n).astype(np.int64) + base)
            tables.append(table)
            base += len(table)
        sig, owner, table = np.concatenate(sigs), np.concatenate(owners), np.concatenate(tables)
        # the same class may come from several tasks
        key = np.stack([table["cls"], table["band"].astype(np.int64)], 1)
        _, first, same = np.unique(key, axis=0, return_index=True, return_inverse=True)
        table, owner = table[first], same.reshape(-1)[owner]
        order = np.lexsort((owner, sig))
        sig, owner = sig[order], owner[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])])
        sig, owner = sig[new], owner[new]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(start, len(sig)))
        start, size = start[size > 1], size[size > 1]
        if not len(start):
            return
        at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        member = owner[at]
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        lists = np.add.reduceat(mix(member.astype(np.uint64) + np.uint64(1)), begin) ^ size.astype(np.uint64)
        _, pick, weight = np.unique(lists, return_index=True, return_counts=True)
        for a in range(0, len(pick), 50_000):
            p, w = pick[a:a + 50_000], weight[a:a + 50_000]
            at = np.repeat(begin[p] - np.concatenate([[0], np.cumsum(size[p])[:-1]]), size[p]) + np.arange(size[p].sum())
            who = table[member[at]]
            bucket = sig[start[p]].astype(np.int64) | part << 40
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (
                np.repeat(bucket, size[p]), np.repeat(w, size[p]).astype(np.int32), np.repeat(size[p], size[p]).astype(np.int32),
                who["band"].astype(np.int32), who["cls"], who["n"].astype(np.int64), who["sure"].astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for p, n, sig, table in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part and rows:
                    yield from find(part, rows)
                    rows = []
                part = p
                rows.append((n, sig, table))
        if rows:
            yield from find(part, rows)
        release()

    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Those of the pairs (a, b) of classes whose sets have J >= 3/4, worked out from one text of each class."""
    marks = classes.select("cls", "mark")
    marked = stored(pairs.join(marks.withColumnsRenamed({"cls": "a", "mark": "mark_a"}), "a")
                    .join(marks.withColumnsRenamed({"cls": "b", "mark": "mark_b"}), "b"), "pairs")
    wanted = marked.select(F.col("mark_a").alias("mark")).union(marked.select("mark_b")).distinct()
    if wanted.count() <= MOST_SENT:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.xxhash64(text).alias("mark"), F.col(text).cast("string").alias("text")).join(wanted, "mark", "left_semi")
    texts = stored(texts.dropDuplicates(["mark"]), "texts")
    full = (marked.join(texts.withColumnsRenamed({"mark": "mark_b", "text": "text_b"}), "mark_b")
            .join(texts.withColumnsRenamed({"mark": "mark_a", "text": "text_a"}), "mark_a").select("a", "b", "text_a", "text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for part in slices(batches, "text_b"):
            ok = []
            for a, _, text_a, text_b in zip(*(c.to_pylist() for c in part.columns)):
                if a != last[0]:
                    last = (a, shingle_set(text_a))
                x, y = last[1], shingle_set(text_b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])
        forget()

    return full.mapInArrow(run, "a long, b long, ok boolean").where("ok").select("a", "b")


def at_band(band: str, what: int) -> Column:
    return F.element_at(F.array(*[F.lit(b[what]) for b in BANDS]), F.col(band) + 1)


def most_apart() -> Column:
    return F.least(F.floor((F.col("n") + F.floor(4 * F.col("n") / 3)) / 7), at_band("band", 0))


def first_candidates(met: DataFrame) -> DataFrame:
    """One pair (a, b) for each class b: with the class it meets most often among the hubs of its buckets.

    The hub of a bucket is its member with most meetings in all its buckets. Pairs run from hubs of more meetings to
    classes of fewer, so they cannot come back in a circle.
    """
    degree = stored(met.groupBy("cls").agg(F.sum(F.col("weight").cast("long") * F.col("shared")).alias("degree"), F.max("n").alias("n")), "degrees")
    ranked = met.join(degree.select("cls", "degree"), "cls")
    hub = stored(ranked.groupBy("bucket").agg(F.max(F.struct("degree", "cls", "n")).alias("hub")), "hubs")
    pair = met.join(hub, "bucket").where("cls <> hub.cls AND 4 * least(n, hub.n) >= 3 * greatest(n, hub.n)")
    votes = pair.groupBy("cls", "n", "sure", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("n_hub"), "band").agg(F.sum("weight").alias("w"))
    enough = F.when(F.col("sure") > 0, F.col("sure") + F.floor((most_apart() - F.floor((F.col("n") + F.col("n_hub")) / 7)) / at_band("band", 2))).otherwise(1)
    votes = votes.where((F.col("w") >= enough) & (F.col("band") == band_of("n", "n_hub")))
    return votes.groupBy("cls").agg(F.max(F.struct("w", "hub")).alias("m")).select(F.col("m.hub").alias("a"), F.col("cls").alias("b"))


def band_of(n: str, other: str) -> Column:
    """The band of two sets by their sizes."""
    h = F.floor((F.col(n) + F.col(other)) / 7)
    return F.size(F.filter(F.array(*[F.lit(b[0]) for b in BANDS]), lambda top: top < h))


def other_candidates(met: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes in different components that meet often enough to be links."""
    rooted = met.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = stored(rooted, "meetings")
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("bucket")
    rows = rooted.join(mixed, "bucket", "left_semi")
    # a pair meets at least so often, so each class can pass over its most crowded meetings but for that many
    least = F.greatest(F.col("sure"), F.lit(1))
    crowded = Window.partitionBy("cls", "band").orderBy(F.desc("shared"), F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("from_here", F.sum("weight").over(crowded)).where(F.col("from_here") >= least)
    blocks = F.ceil(F.col("shared") / BLOCK).cast("int")
    rows = rows.select("bucket", "band", "cls", "n", "root", blocks.alias("blocks"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("own"))
    rows = rows.join(classes.select("cls", "bits"), "cls")
    sent = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "cls", "n", "root", "bits")
    parts = partitions(met.sparkSession)
    return sent.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(compared, "a long, b long").distinct()


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within each bucket (or two blocks of it) whose sizes, band and parities allow a link."""
    found: set[tuple[int, int]] = set()

    def close(rows: list[tuple]) -> None:
        if len(rows) < 2:
            return
        own, band, cls, n, root = (np.array(c, np.int64) for c in zip(*(r[:5] for r in rows)))
        bits = np.frombuffer(b"".join(r[5] for r in rows), np.uint64).reshape(len(rows), -1)
        one = own == own.min()
        for x in range(len(rows)):
            far = np.s_[x + 1:]
            both = n[x] + n[far]
            h = both // 7
            fits = (root[far] != root[x]) & (7 * np.minimum(n[x], n[far]) * 4 >= 21 * np.maximum(n[x], n[far])) & (np.searchsorted(TOPS, h) == band[x])
            if not one.all():
                fits &= one[far] != one[x]
            y = np.flatnonzero(fits) + x + 1
            if len(y):
                apart = np.bitwise_count(bits[y] ^ bits[x]).sum(1)
                for z in y[apart <= h[y - x - 1]]:
                    found.add((min(int(cls[x]), int(cls[z])), max(int(cls[x]), int(cls[z]))))

    def emit() -> pa.RecordBatch:
        a, b = zip(*found)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    key, rows = None, []
    for batch in batches:
        for bucket, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (bucket, i, j) != key:
                close(rows)
                if len(found) > 100_000:
                    yield emit()
                key, rows = (bucket, i, j), []
            rows.append(row)
    close(rows)
    if found:
        yield emit()


def named_classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Every row's set (key, mark, n, cls), and of every class its component: (cls, root, component_id)."""
    parts = partitions(docs.sparkSession)
    sets = stored(set_table(docs, key, text), "sets")
    classes = stored(sets.where("cls IS NOT NULL").groupBy("cls").agg(F.min("key").alias("least"), F.min("mark").alias("mark"), F.min("bits").alias("bits")), "classes")
    met = stored(meetings(filed(docs, text, parts), parts), "meetings")
    best = first_candidates(met)
    first = verified(best, classes, docs, text)
    roots = pointer_roots(first.select(F.col("b").alias("node"), F.col("a").alias("parent")))
    rest = stored(verified(other_candidates(met, roots, classes), classes, docs, text), "links")
    ends = rest
    for c in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(c, F.coalesce(f"root_{c}", c)).drop(f"root_{c}")
    merged = components(ends)
    final = (classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
             .join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").withColumn("root", F.coalesce("top", "root")))
    final = final.select("cls", "root", "least")
    lowest = final.groupBy("root").agg(F.min("least").alias("component_id"))
    return sets, stored(final.join(lowest, "root").select("cls", "root", "component_id"), "components")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row: the smallest key among all rows reached by links, itself included.

    Rows link when their sets of 5-word shingles (lower-cased A-Z, split at ASCII white space; fewer words are one shingle)
    have J >= 3/4. A null text, or one without words, has an empty set and is linked with nothing: its component is its own
    key. Null keys are passed over by the minimum; a component of null keys only has a null id. Rows that share a key are
    judged by their own texts. Other columns are not read.
    """
    sets, named = named_classes(docs, key, text)
    return sets.drop("bits").join(named, "cls", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay when one of each component does.

    The row of the smallest key stays (null keys last; of rows that share a key, the one whose text has the smaller hash; of
    fully equal rows, one). Rows without words are linked with nothing and all stay.
    """
    sets, named = named_classes(docs, key, text)
    sets = sets.drop("bits")
    whole = sets.where("cls IS NOT NULL").join(named.select("cls", "root"), "cls")
    picked = whole.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark")).alias("m")).select("m.key", "m.mark")
    same = sets.join(picked.select(F.col("mark").alias("mark2"), F.col("key").alias("key2")),
                     (F.col("mark") == F.col("mark2")) & F.col("key").eqNullSafe(F.col("key2"))).groupBy("key", "mark").agg(F.count(F.lit(1)).alias("n"))
    same = stored(same.withColumnsRenamed({"key": "key2_", "mark": "mark2_"}), "kept")
    rows = held(docs, F.col(f"`{key}`").alias("key_"), F.xxhash64(f"`{text}`").alias("mark_"), F.col(f"`{text}`").cast("string").alias("text_"))
    kept = rows.where(F.col("text_").rlike(r"[^\x20\x09-\x0D]")).join(same, (F.col("mark_") == F.col("mark2_")) & F.col("key_").eqNullSafe(F.col("key2_")), "left_semi")
    if not same.where("n > 1").isEmpty():                # only then can a row be there twice
        kept = kept.dropDuplicates(["key_", "mark_"])
    wordless = rows.where(~F.coalesce(F.col("text_").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.union(wordless).select(*released(docs.columns))
