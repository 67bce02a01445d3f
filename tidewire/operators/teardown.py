"""TCP teardown: which packets close a conversation.

Inside a run of packets without an idle gap, closing is sequential: a RST closes at once; a FIN waits for the
next ACK without SYN; the packet that opens a conversation never closes it. Windows find each packet's
neighbours; only the packets with FIN or RST, a small share of all, are folded, in blocks of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.scalar import has_flag
from tidewire.schemas import ACK, FIN, RST, SYN, TCP

# what may be known about the conversation before the first packet of a chunk
NOTHING_OPEN, OPEN, FIN_SEEN = 0, 1, 2
# before an event: nothing is open, so that it opens a conversation itself
OPENS = NOTHING_OPEN
# events folded at a time
BLOCK = 512


def _bound(value: str, name: str, use: str) -> str:
    """`use`, in which `name` stands for the value; the value is worked out once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _state(opened: str, waits: str, cuts: str) -> str:
    return f"named_struct('opened', {opened}, 'waits', {waits}, 'cuts', {cuts})"


def _closed(acc: str, by: str) -> str:
    """The state after the packet `by` has closed the conversation."""
    return _state(f"{by}.n + 1", f"cast(null as {PLACE})", f"concat({acc}.cuts, array(named_struct('ts', {by}.ts, 'seq', {by}.seq)))")


def _answered(acc: str, upto: str) -> str:
    """The state when an ACK that was waited for has come before `upto`."""
    return f"if({acc}.waits IS NOT NULL AND ({upto} IS NULL OR {acc}.waits.n < {upto}), {_closed(acc, acc + '.waits')}, {acc})"


PLACE = "struct<n:bigint,ts:bigint,seq:bigint>"
_START = _state(
    f"if(state = {OPENS}, events[0].n, 0L)",
    f"if(state = {FIN_SEEN}, if(events[0].is_ack, named_struct('n', events[0].n, 'ts', events[0].ts, 'seq', events[0].seq), events[0].ack), cast(null as {PLACE}))",
    "cast(array() as array<struct<ts:bigint,seq:bigint>>)")
_STEP = f"""CASE WHEN e.n = s.opened THEN s
  WHEN s.waits.n = e.n OR e.flags & {RST} > 0 THEN {_closed("s", "e")}
  WHEN e.flags & {FIN} > 0 AND s.waits IS NULL THEN {_state("s.opened", "e.ack", "s.cuts")}
  ELSE s END"""
_FOLD = f"aggregate(events, {_START}, (acc, e) -> {_bound(_answered('acc', 'e.n'), 's', _STEP)})"
_LEAVE = f"named_struct('exit', CASE WHEN s.waits IS NOT NULL THEN {FIN_SEEN} WHEN s.opened = next_n THEN {OPENS} ELSE {OPEN} END, 'cuts', s.cuts)"
#: Per entry in `states`, (exit, cuts) of a block of FIN and RST packets (`events`, before the event `next_n`).
#:
#: A state is what one packet can know of those before it: it opens a conversation itself, one is open, or one is open that saw
#: FIN. So a block is a map of three states, whatever it holds, and blocks compose. `cuts` are the packets that close. A FIN
#: waits for the next ACK after it; one that falls before the next event of the run closes in this block.
TRIED = f"transform(states, state -> {_bound(_bound(_FOLD, 'r', _answered('r', 'next_n')), 's', _LEAVE)})"


def closings(packets: DataFrame, parts: list[str]) -> DataFrame:
    """(parts, ts_us, packet_seq) of each packet that closes its conversation by teardown.

    `packets` has one partition of time per `parts`, with `idle_us` (limit), `entry` (what is open before the
    first packet of the partition).
    """
    order = Window.partitionBy(*parts).orderBy("ts_us", "packet_seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_ack = has_flag(F.col("tcp_flags"), ACK) & ~has_flag(F.col("tcp_flags"), SYN)
    place = F.struct("n", F.col("ts_us").alias("ts"), F.col("packet_seq").alias("seq"))

    tcp = packets.filter(F.col("protocol") == TCP).select(
        *parts, "ts_us", "packet_seq", "tcp_flags", "idle_us", "entry")
    numbered = tcp.withColumns({
        "n": F.row_number().over(order),
        "gap": F.col("ts_us") - F.lag("ts_us").over(order),
    }).withColumn(
        "opens_run", F.col("gap").isNull() | (F.col("gap") > F.col("idle_us"))
    ).withColumn(
        "run", F.last(F.when(F.col("opens_run"), F.struct("n", "packet_seq")), ignorenulls=True).over(upto)
    ).withColumns({"run_n": F.col("run.n"), "run_seq": F.col("run.packet_seq")})
    # the next ACK of the same run: smallest later position, read in descending order so that it stays linear
    later = (
        Window.partitionBy(*parts, "run_n").orderBy(F.col("n").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    run = Window.partitionBy(*parts, "run_n").orderBy("n")
    events = (
        numbered.withColumn("ack", F.min(F.when(is_ack, place)).over(later))
        .filter(
            has_flag(F.col("tcp_flags"), FIN | RST)
            | ((F.col("n") == 1) & (F.col("entry") == FIN_SEEN))
        )
        .withColumns({"k": F.row_number().over(run) - 1, "next_n": F.lead("n").over(run),
                      "run_entry": F.when(F.col("run_n") == 1, F.col("entry")).otherwise(NOTHING_OPEN)})
    )
    event = F.struct("n", F.col("ts_us").alias("ts"), F.col("packet_seq").alias("seq"), F.col("tcp_flags").alias("flags"), is_ack.alias("is_ack"), "ack")
    # the windows above put each `parts` group into one partition, so none of this is dealt anew
    blocks = events.groupBy(*parts, "run_n", F.floor(F.col("k") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(event)).alias("events"), F.max("run_entry").alias("run_entry"),      # at most BLOCK
        F.max_by("next_n", "n").alias("next_n"))
    at_start = f"CASE WHEN run_entry <> {NOTHING_OPEN} THEN run_entry WHEN events[0].n = run_n THEN {OPENS} ELSE {OPEN} END"
    tried = blocks.withColumn("states", F.expr(f"if(block = 0, array({at_start}), array({OPENS}, {OPEN}, {FIN_SEEN}))")).withColumn("tried", F.expr(TRIED))
    before = Window.partitionBy(*parts, "run_n").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    exits = F.expr("if(block = 0, array_repeat(tried[0].exit, 3), transform(tried, t -> t.exit))")
    chosen = tried.withColumn("maps", F.collect_list(exits).over(before)).selectExpr(
        *parts, f"explode(get(tried, aggregate(maps, {OPENS}, (state, map) -> map[state])).cuts) AS cut")
    return chosen.select(*parts, F.col("cut.ts").alias("ts_us"), F.col("cut.seq").alias("packet_seq"))
