"""Payload entropy per flow without concatenating payloads.

Bytes are counted in Arrow batches right where the flow's packets already lie in order, so a flow's counts never
travel: a flow inside one partition ends as one row with its entropies. Only flows that reach over several
chunks send their 256 counts (a bounded few) through one more aggregate. Before packets are moved, `tallied` cuts long
payloads down to their first bytes and how often each byte follows, which is all that the entropies need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.scalar import entropy_of_counts, is_dns
from tidewire.schemas import DNS_HEADER_BYTES, FLOW_ID, FLOW_KEY, fields

_SLICE_BYTES = 4 << 20
_SLICE_ROWS = 4096
_MOST = 255                 # a byte that occurs more often takes several pairs
TALLY_BYTES = 64            # payloads up to this long travel as they are


def _entropies(counts: np.ndarray) -> np.ndarray:
    """Bits per byte of each row of a (flows, 256) count matrix, of which most entries are 0."""
    flat = counts.reshape(-1)
    at = np.flatnonzero(flat > 0)
    flow, c = at // 256, flat[at].astype(np.float64)
    n = np.bincount(flow, weights=c, minlength=len(counts))
    weighted = np.bincount(flow, weights=c * np.log2(c), minlength=len(counts))
    total = np.where(n > 0, n, 1.0)
    return np.maximum(np.log2(total) - weighted / total, 0.0)


def _changes(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """True where a row belongs to another flow than the row before."""
    out = np.zeros(batch.num_rows, dtype=bool)
    for name in columns:
        col = batch.column(name)
        out[1:] |= pc.not_equal(col.slice(1), col.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    return out


def _byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row offsets, bytes) of a binary column, without copying."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, data


def pairs_of(payloads: pa.Array) -> pa.Array:
    """Per row, its bytes as pairs of a byte and how often it occurs (1 to 255); empty for null."""
    offsets, data = _byte_view(payloads)
    sizes, pairs = [], []
    start = 0
    while start < len(payloads):
        stop = int(np.searchsorted(offsets, offsets[start] + _SLICE_BYTES, side="left"))
        stop = min(max(stop, start + 1), start + _SLICE_ROWS, len(payloads))
        codes = np.repeat(np.arange(stop - start) * 256, np.diff(offsets[start:stop + 1]))
        codes += data[offsets[start]:offsets[stop]]
        counts = np.bincount(codes, minlength=(stop - start) * 256)
        found = np.flatnonzero(counts > 0)
        n = counts[found]
        times = -(-n // _MOST)
        ends = np.cumsum(times)
        out = np.full((int(times.sum()), 2), _MOST, np.uint8)
        out[:, 0] = np.repeat(found % 256, times)
        out[ends - 1, 1] = n - _MOST * (times - 1)
        pairs.append(out.reshape(-1))
        sizes.append(np.bincount(found // 256, weights=2 * times, minlength=stop - start))
        start = stop
    at = np.concatenate([[0], *sizes]).cumsum().astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint8), *pairs])
    return pa.Array.from_buffers(pa.binary(), len(payloads), [None, pa.py_buffer(at), pa.py_buffer(flat)])


def tallied(packets: DataFrame) -> DataFrame:
    """Packets whose long payloads are cut to their first bytes, with `tally`: the pairs (see `pairs_of`) of the others.

    For `payload_entropies`, before packets are dealt out by conversation: a text of thousands of bytes moves as some hundred.
    """
    def count(rest: pa.Array) -> pa.Array:
        return pairs_of(rest)

    size = F.octet_length("payload")
    cut = size > TALLY_BYTES
    rest = F.substring("payload", F.lit(DNS_HEADER_BYTES + 1), size - DNS_HEADER_BYTES)
    return packets.withColumns({
        "tally": F.arrow_udf(count, "binary")(F.when(cut, rest)),
        "payload": F.when(cut, F.substring("payload", 1, DNS_HEADER_BYTES)).otherwise(F.col("payload")),
    })


def count_bytes(batches: Iterator[pa.RecordBatch], with_counts: bool) -> Iterator[pa.RecordBatch]:
    """Ordered forward payloads to one row per flow (or flow piece): entropies, or counts and first bytes."""
    held = None         # the flow that may go on in the next batch: (key row, counts, first bytes)
    ids = None

    def rows(keys, counts, heads):
        arrays = [keys.column(n) for n in ids]
        if with_counts:
            flat = pa.array(counts.reshape(-1), pa.int64())
            at = pa.array(np.arange(0, flat.__len__() + 1, 256), pa.int32())
            extra = {"head": pa.array(heads, pa.binary()), "counts": pa.ListArray.from_arrays(at, flat)}
        else:
            dns = np.flatnonzero(keys.column("is_dns").to_numpy(zero_copy_only=False))
            rest = counts[dns]
            for i in np.flatnonzero(rest.sum(axis=1) > DNS_HEADER_BYTES):
                rest[i] -= np.bincount(np.frombuffer(heads[dns[i]], np.uint8), minlength=256)
            queries = np.zeros(len(counts))
            queries[dns] = _entropies(rest)
            extra = {"payload_entropy": pa.array(_entropies(counts)), "dns_query_entropy": pa.array(queries)}
        return pa.RecordBatch.from_arrays(arrays + list(extra.values()), ids + list(extra))

    for batch in batches:
        if batch.num_rows == 0:
            continue
        if ids is None:
            ids = [n for n in batch.schema.names if n not in ("payload", "tally", "is_dns")]
        identity = batch.select(ids + ["is_dns"])
        change = _changes(batch, ids)
        if held is not None:
            first = identity.slice(0, 1)
            change[0] = any(first.column(n)[0] != held[0].column(n)[0] for n in ids)
        offsets, data = _byte_view(batch.column("payload"))
        places, pairs = _byte_view(batch.column("tally"))
        size = offsets + places
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(size, size[start] + _SLICE_BYTES, side="left"))
            stop = min(max(stop, start + 1), batch.num_rows)
            local = change[start:stop].copy()
            joins_held = held is not None and not local[0]
            local[0] = False
            flow_of_row = np.cumsum(local)
            firsts = np.concatenate(([0], np.flatnonzero(local))) + start
            n_flows = len(firsts)
            lengths = np.diff(offsets[start:stop + 1])
            codes = np.repeat(flow_of_row * 256, lengths)
            codes += data[offsets[start]:offsets[stop]]
            counts = np.bincount(codes, minlength=n_flows * 256)
            if places[start] < places[stop]:
                codes = np.repeat(flow_of_row * 256, np.diff(places[start:stop + 1]) // 2)
                codes += pairs[places[start]:places[stop]:2]
                counts = counts + np.bincount(
                    codes, weights=pairs[places[start] + 1:places[stop]:2], minlength=n_flows * 256).astype(np.int64)
            counts = counts.reshape(n_flows, 256)
            ends = np.concatenate((firsts[1:], [stop]))
            heads = [
                data[offsets[a]:min(offsets[a] + DNS_HEADER_BYTES, offsets[b])].tobytes()
                for a, b in zip(firsts, ends)
            ]
            keys = identity.take(pa.array(firsts, pa.int64()))
            if joins_held:
                counts[0] += held[1]
                heads[0] = (held[2] + heads[0])[:DNS_HEADER_BYTES]
            elif held is not None:
                yield rows(held[0], held[1][None, :], [held[2]])
            if n_flows > 1:
                yield rows(keys.slice(0, n_flows - 1), counts[:-1], heads[:-1])
            held = (keys.slice(n_flows - 1, 1), counts[-1], heads[-1])
            start = stop
    if held is not None:
        yield rows(held[0], held[1][None, :], [held[2]])


def _count(assigned: DataFrame, ids: list[str], with_counts: bool) -> DataFrame:
    if "tally" not in assigned.columns:
        assigned = assigned.withColumn("tally", F.lit(None).cast("binary"))
    payloads = (
        assigned.filter(F.col("is_fwd") & (F.octet_length("payload") > 0))
        # already in this order after flow assignment; Spark drops the sort when it sees that
        .sortWithinPartitions(*FLOW_KEY, *[c for c in ids if c == "chunk"], "ts_us", "packet_seq")
        .select(*ids, is_dns(F.col("lo_port"), F.col("hi_port")).alias("is_dns"), "payload", "tally")
    )
    extra = "head binary, counts array<bigint>" if with_counts else "payload_entropy double, dns_query_entropy double"
    schema = T.StructType(
        [payloads.schema[c] for c in ids] + fields(extra))

    def run(batches):
        return count_bytes(batches, with_counts)

    return payloads.mapInArrow(run, schema)


def payload_entropies(assigned: DataFrame, in_chunks: bool = False) -> DataFrame:
    """(flow, payload_entropy, dns_query_entropy) for flows with forward payload.

    Expects each flow (each chunk of a flow) to lie in one partition, as it does after flow assignment, of packets as they
    are or `tallied`.
    DNS entropy is taken where either port is 53, over the forward bytes after the first 12 when there are
    more than 12.
    """
    if not in_chunks:
        return _count(assigned, FLOW_ID, False)
    spans = F.col("span_gap_n").isNotNull()
    whole = _count(assigned.filter(~spans), FLOW_ID, False)
    pieces = _count(assigned.filter(spans), FLOW_ID + ["chunk"], True)
    counted = pieces.select(*FLOW_ID, F.posexplode("counts").alias("byte", "n")).withColumn("skip", F.lit(0))
    head = (
        pieces.groupBy(*FLOW_ID)
        .agg(F.sort_array(F.collect_list(F.struct("chunk", "head"))).alias("heads"))   # one entry per chunk
        .select(*FLOW_ID, F.substring(
            F.aggregate("heads", F.lit(""), lambda acc, h: F.concat(acc, F.hex(h["head"]))),
            1, 2 * DNS_HEADER_BYTES).alias("hex"))
        .filter(F.length("hex") > 0)
        .select(*FLOW_ID, F.explode(F.transform(
            F.sequence(F.lit(1), F.length("hex"), F.lit(2)),
            lambda i: F.conv(F.substring("hex", i, F.lit(2)), 16, 10).cast("int"))).alias("byte"))
        .withColumns({"n": F.lit(0).cast("bigint"), "skip": F.lit(1)})
    )
    sums = counted.unionByName(head).groupBy(*FLOW_ID, "byte").agg(F.sum("n").alias("n"), F.sum("skip").alias("skip"))
    flows = sums.groupBy(*FLOW_ID).agg(
        F.collect_list(F.col("n").cast("double")).alias("all"),                         # 256 entries
        F.collect_list((F.col("n") - F.col("skip")).cast("double")).alias("rest"),
        F.sum("n").alias("total"),
    )
    body = F.when(F.col("total") > DNS_HEADER_BYTES, F.col("rest")).otherwise(F.col("all"))
    return whole.unionByName(flows.select(
        *FLOW_ID, entropy_of_counts(F.col("all")).alias("payload_entropy"),
        F.when(is_dns(F.col("lo_port"), F.col("hi_port")), entropy_of_counts(body)).otherwise(0.0)
        .alias("dns_query_entropy"),
    ))
