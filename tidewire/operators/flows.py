"""Packets to bidirectional conversations ("flows").

The plan: one hash exchange on the 5-tuple, one sort, a few windows that share that order, one hash
aggregate. Conversations too heavy for one task are cut into chunks of time (`skew.plan_cuts`); what crosses a
cut is a handful of numbers per chunk, worked out beforehand and broadcast (`resolve_chunks`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.packets import flow_id, with_flow_key
from tidewire.functions.scalar import has_flag
from tidewire.operators import skew
from tidewire.operators.teardown import FIN_SEEN, NOTHING_OPEN, OPEN, closings
from tidewire.schemas import (
    FIN, FLOW_ID, FLOW_KEY, MIN_PACKETS, TCP, TCP_IDLE_SECONDS, UDP_IDLE_SECONDS, fields,
)


@dataclass(frozen=True)
class FlowRules:
    """When a conversation ends. Teardown applies to TCP; `udp_seconds` to everything that is not TCP."""

    tcp_seconds: float = TCP_IDLE_SECONDS
    udp_seconds: float = UDP_IDLE_SECONDS
    teardown: bool = True
    chunk_rows: int = skew.CHUNK_ROWS

    def idle_us(self) -> Column:
        return F.when(F.col("protocol") == TCP, F.lit(round(self.tcp_seconds * 1_000_000))).otherwise(
            F.lit(round(self.udp_seconds * 1_000_000))).cast("bigint")


@dataclass
class Chunks:
    """Heavy conversations: where they are cut, and what is open at the start of each chunk."""

    cuts: skew.Cuts
    entries: DataFrame      # key, chunk -> entry, entry_ts, entry_flow, entry_lo, entry_lo_ts, entry_hi_ts
    spanning: DataFrame     # key, flow_seq of flows in more than one chunk -> gap_sum, gap_n over all of it


def _number(packets: DataFrame, parts: list[str], teardown: bool) -> DataFrame:
    """Adds per packet: `starts` (opens a flow), `iat_us`, `local_flow` (count of opened flows so far).

    Closing packets come in as marker rows that sort right after their packet, so finding "the packet after a
    closing" needs neither a join nor a second exchange of packets.
    """
    rows = packets.withColumn("is_mark", F.lit(False))
    if teardown:
        # few rows, in an exchange of their own that the branches of a plan share, so that closings are worked out once; by
        # another column than `parts`, as Spark drops an exchange that deals rows out as they already lie
        marks = closings(packets, parts).repartition("packet_seq").withColumn("is_mark", F.lit(True))
        rows = rows.unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy(*parts).orderBy("ts_us", "packet_seq", "is_mark")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before_ts = F.lag("ts_us").over(order)
    # at the first row of a partition nothing precedes, but a chunk may continue an open flow
    continues = F.col("prev_ts").isNull() & (F.col("entry") != NOTHING_OPEN)
    gap = F.col("ts_us") - F.coalesce(F.col("prev_ts"), F.col("entry_ts"))
    starts = F.when(F.col("is_mark"), F.lit(False)).when(continues, F.lit(False)).otherwise(
        F.col("prev_ts").isNull() | F.coalesce(F.col("prev_mark"), F.lit(False)) | (gap > F.col("idle_us")))
    return (
        rows.withColumns({"prev_ts": before_ts, "prev_mark": F.lag("is_mark").over(order)})
        .withColumn("starts", starts)
        .withColumns({
            "iat_us": F.when(~F.col("starts"), gap),
            "local_flow": F.sum(F.col("starts").cast("bigint")).over(upto),
            "start_lo": F.last(F.when(F.col("starts"), F.col("from_lo")), ignorenulls=True).over(upto),
        })
    )




def _chunk_summaries(heavy: DataFrame, rules: FlowRules) -> DataFrame:
    """One row per (heavy key, chunk, assumed entry state): how the chunk would end, and its edge pieces.

    Reads narrow columns of the heavy keys only. Trying all three entry states makes the chunks independent
    of one another.
    """
    parts = FLOW_KEY + ["chunk", "entry"]
    tried = heavy.withColumns({
        "entry": F.explode(F.array(F.lit(NOTHING_OPEN), F.lit(OPEN), F.lit(FIN_SEEN))),
        "entry_ts": F.lit(None).cast("bigint"),
    })
    numbered = _number(tried, parts, rules.teardown)
    is_fin = has_flag(F.col("tcp_flags"), FIN) & (F.col("protocol") == TCP)
    real = ~F.col("is_mark")
    pieces = numbered.groupBy(*parts, "local_flow").agg(
        F.max(F.col("starts")).alias("opened"),
        F.coalesce(F.max(real & is_fin & ~F.col("starts")), F.lit(False)).alias("fin"),
        F.max(F.struct("ts_us", "packet_seq", "is_mark")).alias("last"),
        F.min("ts_us").alias("first_ts"),
        F.max("start_lo").alias("start_lo"),
        F.coalesce(F.sum("iat_us"), F.lit(0)).alias("gap_sum"),
        F.count(F.when(real, F.col("iat_us"))).alias("gap_n"),
        F.max(F.when(real & F.col("from_lo"), F.col("ts_us"))).alias("lo_ts"),
        F.max(F.when(real & ~F.col("from_lo"), F.col("ts_us"))).alias("hi_ts"),
        F.count(F.when(real, 1)).alias("n_rows"),
    )
    side = F.struct("start_lo", "gap_sum", "gap_n", "lo_ts", "hi_ts", "n_rows")
    tail = F.max_by(F.struct(side.alias("side"), "fin", "last"), "local_flow")
    summary = pieces.groupBy(*parts).agg(
        F.max("local_flow").alias("n_flows"),
        F.min("first_ts").alias("first_ts"),
        F.max(F.when(F.col("local_flow") == 0, side)).alias("head"),
        tail.alias("tail"),
    )
    fin_open = F.col("tail.fin") | ((F.col("n_flows") == 0) & (F.col("entry") == FIN_SEEN))
    leaves = F.when(F.col("tail.last.is_mark"), NOTHING_OPEN).when(fin_open, FIN_SEEN).otherwise(OPEN)
    return summary.select(
        *parts, "n_flows", "first_ts", F.col("tail.last.ts_us").alias("last_ts"), leaves.alias("leaves"),
        "head", F.col("tail.side").alias("tail"),
    )


def resolve_chunks(keyed: DataFrame, cuts: skew.Cuts, rules: FlowRules) -> Chunks:
    """Walks the chunks of each heavy key in order and notes what is open at the start of each.

    Only chunk summaries come here, at most three per chunk and `skew.MAX_CUTS` chunks in all.
    """
    narrow = keyed.select(*FLOW_KEY, "ts_us", "packet_seq", "tcp_flags", "from_lo")
    heavy = narrow.join(F.broadcast(cuts.table.select(*FLOW_KEY)), FLOW_KEY, "left_semi")
    heavy = skew.with_chunk(heavy, cuts).withColumn("idle_us", rules.idle_us())
    by_key: dict[tuple, dict[int, dict[int, object]]] = {}
    for row in _chunk_summaries(heavy, rules).collect():
        key = tuple(row[c] for c in FLOW_KEY)
        by_key.setdefault(key, {}).setdefault(row["chunk"], {})[row["entry"]] = row
    entries, spanning = [], []
    for key, chunks in by_key.items():
        idle = round((rules.tcp_seconds if key[4] == TCP else rules.udp_seconds) * 1_000_000)
        flow, last_ts, leaves = 0, None, NOTHING_OPEN
        lo_side = lo_ts = hi_ts = None
        gap_sum = gap_n = pieces = 0
        for chunk in sorted(chunks):
            first_ts = chunks[chunk][NOTHING_OPEN]["first_ts"]
            entry = leaves if last_ts is not None and first_ts - last_ts <= idle else NOTHING_OPEN
            row = chunks[chunk][entry]
            entries.append(key + (chunk, entry, last_ts if entry else None, flow, lo_side if entry else None,
                                  lo_ts if entry else None, hi_ts if entry else None))
            if entry:
                piece = row["head"]
                gap_sum += first_ts - last_ts + piece["gap_sum"]
                gap_n += 1 + piece["gap_n"]
                pieces += 1
                lo_ts = piece["lo_ts"] if piece["lo_ts"] is not None else lo_ts
                hi_ts = piece["hi_ts"] if piece["hi_ts"] is not None else hi_ts
            if row["n_flows"]:
                if pieces > 1:
                    spanning.append(key + (flow, gap_sum, gap_n))
                flow += row["n_flows"]
                piece = row["tail"]
                lo_side, lo_ts, hi_ts = piece["start_lo"], piece["lo_ts"], piece["hi_ts"]
                gap_sum, gap_n, pieces = piece["gap_sum"], piece["gap_n"], 1
            last_ts, leaves = row["last_ts"], row["leaves"]
        if pieces > 1:
            spanning.append(key + (flow, gap_sum, gap_n))
    key_fields = [keyed.schema[c] for c in FLOW_KEY]

    def table(rows, ddl):
        return skew.frozen(keyed.sparkSession, rows, T.StructType(key_fields + fields(ddl)))

    return Chunks(
        cuts,
        table(entries, "chunk int, entry int, entry_ts bigint, entry_flow bigint, entry_lo boolean, "
                       "entry_lo_ts bigint, entry_hi_ts bigint"),
        table(spanning, "flow_seq bigint, span_gap_sum bigint, span_gap_n bigint"),
    )


def find_chunks(packets: DataFrame, rules: FlowRules = FlowRules()) -> Chunks | None:
    """Looks for conversations too heavy for one task. Worth keeping when several outputs share one input."""
    keyed = with_flow_key(packets)
    cuts = skew.plan_cuts(keyed, rules.chunk_rows)
    return resolve_chunks(keyed, cuts, rules) if cuts is not None else None


def assign_flows(
    packets: DataFrame, rules: FlowRules = FlowRules(), chunks: Chunks | str | None = "auto",
) -> DataFrame:
    """Every packet with its flow: `flow_seq` (from 1 within the 5-tuple), `is_fwd`, `iat_us`, `starts`.

    Also carries `chunk` (all 0 unless heavy conversations were found) and `span_gap_sum`, `span_gap_n`, set
    for flows that reach over several chunks. Other columns of `packets` pass through; columns nobody
    uses later are pruned before the exchange.
    """
    if chunks == "auto":
        chunks = find_chunks(packets, rules)
    keyed = with_flow_key(packets).withColumn("idle_us", rules.idle_us())
    nothing = {
        "entry": F.lit(NOTHING_OPEN), "entry_ts": F.lit(None).cast("bigint"), "entry_flow": F.lit(0).cast("bigint"),
        "entry_lo": F.lit(None).cast("boolean"), "entry_lo_ts": F.lit(None).cast("bigint"),
        "entry_hi_ts": F.lit(None).cast("bigint"),
    }
    if chunks is None:
        parts = FLOW_KEY
        ready = keyed.withColumns(nothing)
    else:
        parts = FLOW_KEY + ["chunk"]
        ready = skew.with_chunk(keyed, chunks.cuts).join(
            F.broadcast(chunks.entries), parts, "left")     # bounded by skew.MAX_CUTS
        ready = ready.withColumns({c: F.coalesce(F.col(c), nothing[c]) for c in nothing})
    numbered = _number(ready, parts, rules.teardown).filter(~F.col("is_mark"))
    flows = numbered.withColumns({
        "flow_seq": F.col("entry_flow") + F.col("local_flow"),
        "is_fwd": F.col("from_lo") == F.coalesce("start_lo", "entry_lo"),
    }).drop("is_mark", "prev_ts", "prev_mark", "start_lo", "entry_lo", "entry_flow", "idle_us")
    if chunks is None:
        none = F.lit(None).cast("bigint")
        return flows.withColumns({"chunk": F.lit(0), "span_gap_sum": none, "span_gap_n": none})
    return flows.join(F.broadcast(chunks.spanning), FLOW_ID, "left")


def flow_window_keys(assigned_in_chunks: bool) -> list[str]:
    return FLOW_ID + (["chunk"] if assigned_in_chunks else [])


def side_gaps(assigned: DataFrame) -> DataFrame:
    """Adds `iat_fwd_us` / `iat_bwd_us`: time since the flow's last packet of the same direction."""
    order = Window.partitionBy(*FLOW_KEY, "chunk", "flow_seq", "from_lo").orderBy("ts_us", "packet_seq")
    carried = F.when(
        F.col("local_flow") == 0, F.when(F.col("from_lo"), F.col("entry_lo_ts")).otherwise(F.col("entry_hi_ts")))
    gap = F.col("ts_us") - F.coalesce(F.lag("ts_us").over(order), carried)
    return (
        assigned.withColumn("_gap", gap)
        .withColumns({
            "iat_fwd_us": F.when(F.col("is_fwd"), F.col("_gap")),
            "iat_bwd_us": F.when(~F.col("is_fwd"), F.col("_gap")),
        })
        .drop("_gap")
    )


def flow_ends() -> dict[str, Column]:
    """Who talks to whom, from the direction of a flow's first packet (needs `fwd_lo`)."""
    def pick(a, b):
        return F.when(F.col("fwd_lo"), F.col(a)).otherwise(F.col(b))

    return {
        "src_ip": pick("lo_ip", "hi_ip"), "src_port": pick("lo_port", "hi_port"),
        "dst_ip": pick("hi_ip", "lo_ip"), "dst_port": pick("hi_port", "lo_port"),
    }


def summarise_flows(assigned: DataFrame, extra: list[Column] = []) -> DataFrame:
    """One row per flow, also the short ones: times, counts and bytes per direction, flag unions."""
    fwd, bwd = F.col("is_fwd"), ~F.col("is_fwd")

    def total(column, side=None):
        value = F.col(column) if side is None else F.when(side, F.col(column))
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    def flags(side):
        return F.coalesce(F.bit_or(F.when(side, F.col("tcp_flags"))), F.lit(0)).cast("int")

    flows = assigned.groupBy(*FLOW_ID).agg(
        # the sender of forward packets; every flow has one
        F.max(F.when(fwd, F.col("from_lo"))).alias("fwd_lo"),
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
        F.count(F.lit(1)).alias("total_packets"),
        F.count(F.when(fwd, 1)).alias("fwd_packets"), F.count(F.when(bwd, 1)).alias("bwd_packets"),
        total("length").alias("total_bytes"),
        total("length", fwd).alias("fwd_bytes"), total("length", bwd).alias("bwd_bytes"),
        total("payload_len", fwd).alias("fwd_payload_bytes"), total("payload_len", bwd).alias("bwd_payload_bytes"),
        flags(fwd).alias("fwd_tcp_flags"), flags(bwd).alias("bwd_tcp_flags"),
        *extra,
    )
    return flows.withColumns({
        **flow_ends(),
        "flow_id": flow_id(),
        "duration_s": F.greatest(F.col("end_us") - F.col("start_us"), F.lit(0)) / F.lit(1e6),
    })


def long_enough(flows: DataFrame, min_packets: int = MIN_PACKETS) -> DataFrame:
    return flows.filter(F.col("total_packets") >= min_packets)


def builder_stats(flows: DataFrame, min_packets: int = MIN_PACKETS) -> DataFrame:
    """Packets seen, flows kept, flows too short; from summaries that still hold the short flows."""
    kept = F.col("total_packets") >= min_packets
    return flows.agg(
        F.coalesce(F.sum("total_packets"), F.lit(0)).alias("packets_seen"),
        F.count_if(kept).alias("flows_completed"),
        F.count_if(~kept).alias("flows_discarded"),
    )


def flows_by_start(flows: DataFrame) -> DataFrame:
    return flows.orderBy("start_us", "flow_id", "flow_seq")
