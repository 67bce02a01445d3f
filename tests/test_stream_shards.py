import random

from helpers import packet, packets_df, reference_flows
from pyspark.sql import functions as F

from tidewire.streaming import flows as SF


def conversations(n, seed=5):
    rng, rows = random.Random(seed), []
    for u in range(n):
        ts, ends = 10 ** 12 + u, ((f"10.0.0.{u}", 4000 + u), ("10.0.1.1", 80))
        for _ in range(12):
            ts += rng.choice([1, 400_000, 3_000_000, 70_000_000, 130_000_000])
            rows.append(packet(len(rows), ts, *ends[::rng.choice([1, -1])], 6 if u % 3 else 17, rng.choice([16] * 8 + [17, 20]), payload_len=3, payload=b"abc"))
    return rows


class Map:
    def __init__(self): self.d = {}
    def getValue(self, k): return self.d[k]
    def updateValue(self, k, v): self.d[k] = v
    def removeKey(self, k): del self.d[k]


class Row:
    def __init__(self, calls): self.v, self.calls = None, calls
    def get(self): self.calls.append("get"); return self.v
    def update(self, v): self.calls.append("update"); self.v = v
    def clear(self): self.calls.append("clear"); self.v = None


class Handle:
    def __init__(self): self.calls, self.timers, self.maps = [], set(), []
    def getValueState(self, *_): return Row(self.calls)
    def getMapState(self, *_): self.maps.append(Map()); return self.maps[-1]
    def registerTimer(self, at): self.calls.append("timer"); self.timers.add(at)
    def deleteTimer(self, at): self.timers.remove(at)


class Now:
    def __init__(self, ms): self.ms = ms
    def getCurrentWatermarkInMs(self): return self.ms


def test_conversations_of_a_shard_share_calls_and_tables(spark):
    """Each conversation had calls, state rows, timers and tables of its own."""
    rows = conversations(40)
    keyed = SF.with_flow_key(packets_df(spark, rows)).withColumn("conversation", SF.conversation())
    frame = keyed.select("conversation", *SF.CARRIED).toPandas()
    handle, shard = Handle(), SF.Shards(SF.Flows(120_000_000, 60_000_000, True, True))
    shard.init(handle)
    assert not list(shard.handleInputRows((1,), iter([frame]), Now(0)))
    assert handle.calls == ["get", "timer", "update"] and len(handle.timers) == 1
    fired, end = handle.timers.copy(), (10 ** 12 + 10 ** 10) // 1000
    out = list(shard.handleExpiredTimer((1,), Now(end), type("E", (), {"getExpiryTimeInMs": lambda self: min(fired)})()))
    assert len(out) == 1 and handle.calls[3:] == ["get", "clear"]
    got, want, first = out[0][out[0].kind == "packet"], reference_flows(rows), {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        first.setdefault(want[r[0]][:2], r[0])
    assert {(p, f, w) for p, f, w in zip(got.packet_seq, got.flow_seq, got.is_fwd)} == {(s, first[(k, no)], f) for s, (k, no, f) in want.items()}
    assert (out[0].kind == "closed").sum() == len(first)
    assert {tuple(k) for k in out[0][["lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"]].to_numpy().tolist()} == {(*k[:2], *k[2:]) for k, _, _ in want.values()}


def test_any_number_of_shards_gives_the_same_flows(spark, tmp_path):
    rows, found = conversations(25), []
    for part in range(3):
        packets_df(spark, sorted(rows, key=lambda r: r[1])[part * 100:(part + 1) * 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    SF.heartbeat(spark, str(tmp_path / "in"), max(r[1] for r in rows) + 400_000_000)
    for shards, few in ((1, 0), (1024, 0), (1, 1 << 18), (1024, 1 << 18)):
        out = str(tmp_path / f"out{shards}-{few}")
        stream = SF.assign_flow_stream(SF.packet_stream(spark, str(tmp_path / "in"), files_per_batch=1), few_bytes=few, shards=shards)
        SF.run_available(stream, out, str(tmp_path / f"cp{shards}-{few}"))
        found.append(sorted(map(str, spark.read.parquet(out).collect())))
    assert found[0] == found[1] and found[2] == found[3] and len(found[0]) == len(found[2]) > len(rows)


def test_keys_that_are_null_make_a_conversation(spark):
    one = packets_df(spark, [packet(0, 1, ("10.0.0.1", 5))]).withColumns({"src_ip": F.lit(None).cast("string"), "src_port": F.lit(None).cast("int")})
    name = SF.with_flow_key(one).select(SF.conversation()).first()[0]
    ends, shard = [], SF.Shards(SF.Flows(1, 1, True, False))
    shard.init(Handle())
    list(shard.visited([(name, lambda key: ends.append(key) or [])]))
    assert ends == [tuple(SF.with_flow_key(one).select("lo_ip", "lo_port", "hi_ip", "hi_port", "protocol").first())]


def test_many_gaps_move_to_the_map():
    handle = Handle()
    desk = SF.Desk(handle.getMapState(), handle.getMapState())
    desk.name, gaps = "a", desk.getListState()
    gaps.appendValue((b"12345678",))
    assert list(gaps.get()) == [(b"12345678",)] and not handle.maps[1].d
    gaps.appendValue((b"x" * SF.FEW_BYTES,))
    gaps.appendValue((b"87654321",))
    assert b"".join(g for g, in gaps.get()) == b"12345678" + b"x" * SF.FEW_BYTES + b"87654321" and list(handle.maps[1].d) == [("a", 0)]
    gaps.clear()
    assert not list(gaps.get()) and not handle.maps[1].d
