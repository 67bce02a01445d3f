import contextlib
import io
import random
import struct

import pytest
from pyspark.sql import functions as F

from tests.test_capture_ranges import pcap, some_frames
from tidewire.functions.decode import counted_frames, decode_frames, decode_stats, packets_of
from tidewire.sources import capture, capture_source
from tidewire.streaming.flows import run_available


def packet(rng, i):
    src, dst = (bytes([10, 0, 0, rng.randrange(1, 6)]) for _ in range(2))
    body = struct.pack(">HHHH", rng.choice([53, 443, 5000]), rng.choice([53, 80]), 8, 0) + rng.randbytes(rng.randrange(40))
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), i % 65536, 0, 64, 17, 0) + src + dst
    return bytes(12) + (b"\x08\x06" + bytes(30) if i % 7 == 3 else b"\x08\x00" + ip + body)


@pytest.fixture
def captures(tmp_path):
    rng, frames = random.Random(4), []
    (tmp_path / "in").mkdir()
    for k in range(2):
        part = [(10 ** 15 + (k * 300 + i) * 1000, packet(rng, i)) for i in range(300)]
        (tmp_path / "in" / f"{k}.pcap").write_bytes(pcap(part))
        frames += [(k << capture.FILE_SHIFT) + i for i in range(300)]
    return tmp_path


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_the_source_reads_what_the_scan_reads(spark, captures):
    index = capture_source.kept_index(spark, f"{captures}/in/*.pcap", 2000)
    capture_source.register(spark)
    found = spark.read.format("capture").load(index)
    want = capture.capture_scan(spark, f"{captures}/in/*.pcap", 2000)
    assert found.schema == want.schema
    assert sorted(found.collect()) == sorted(want.collect()) and found.count() == 600
    some = found.where("ts_us >= 1000000000450000 AND ts_us < 1000000000500000 AND frame_no <> 151")
    assert sorted(r.frame_no for r in some.collect()) == [i for i in range(150, 200) if i != 151]
    conditions = [line for line in plan(some).splitlines() if "Condition" in line]
    assert not any("ts_us" in line for line in conditions) and any("frame_no" in line for line in conditions)


def test_ranges_outside_the_times_are_not_opened(spark, captures):
    index = capture_source.kept_index(spark, f"{captures}/in/*.pcap", 2000)
    capture_source.register(spark)
    every = spark.read.format("capture").load(index)
    few = every.where("ts_us >= 1000000000450000 AND ts_us < 1000000000460000")
    assert every.rdd.getNumPartitions() > 8 and few.rdd.getNumPartitions() <= 2 and few.count() == 10
    assert every.where("ts_us IN (1000000000450000, 1000000000000000)").count() == 2
    assert every.where("ts_us = 5").count() == 0 and every.where("ts_us <= 1000000000000000").count() == 1


@pytest.mark.parametrize("hosts,ports", [(("10.0.0.2", "10.0.0.3"), (53, 443)), ((), (0,))])
def test_hosts_and_ports(spark, captures, hosts, ports):
    index = capture_source.kept_index(spark, f"{captures}/in/*.pcap", 2000)
    found = capture_source.captured_packets(spark, index, hosts, ports, 10 ** 15 + 20_000, 10 ** 15 + 500_000)
    want = [r for r in packets_of(decode_frames(capture.capture_scan(spark, f"{captures}/in/*.pcap"))).collect()
            if (not hosts or {r.src_ip, r.dst_ip} & set(hosts)) and (not ports or {r.src_port, r.dst_port} & set(ports))
            and 10 ** 15 + 20_000 <= r.ts_us < 10 ** 15 + 500_000]
    assert sorted(found.collect()) == sorted(want) and (want or ports == (0,))


@pytest.mark.parametrize("n", [100, 10_000])
def test_the_first_packets_come_from_the_first_ranges(spark, captures, n):
    index = capture_source.kept_index(spark, f"{captures}/in/*.pcap", 2000)
    every = packets_of(decode_frames(capture.capture_scan(spark, f"{captures}/in/*.pcap"))).orderBy("packet_seq").collect()
    assert capture_source.first_packets(spark, index, n).collect() == every[:n]
    if n == 100:                                     # the second file is gone and not missed
        (captures / "in" / "1.pcap").write_bytes(b"")
        assert capture_source.first_packets(spark, index, n).count() == n


def test_a_growing_capture_gives_each_frame_once(spark, tmp_path):
    rng = random.Random(9)
    frames = [(10 ** 15 + i * 1000, packet(rng, i)) for i in range(200)]
    data, other = pcap(frames), pcap(frames[:20])
    where = tmp_path / "in"
    where.mkdir()

    def run():
        stream = capture_source.capture_stream(spark, str(where), str(tmp_path / "state"), split_bytes="1500")
        run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        return spark.read.parquet(str(tmp_path / "out"))

    (where / "b.pcap").write_bytes(data[:10])        # not even a header
    (where / "note.txt").write_text("no capture")
    (where / "b.pcap").write_bytes(data[:3003])      # ends inside a frame
    first = run().count()
    assert 0 < first < 200
    (where / "b.pcap").write_bytes(data[:-4])
    (where / "a.pcap").write_bytes(other)            # sorts before the first, and is numbered after it
    run()
    (where / "b.pcap").write_bytes(data)
    got = run()
    again = run()
    good = [i for i in range(200) if i % 7 != 3]
    assert sorted(r[0] for r in got.where(F.col("packet_seq") < 1 << capture.FILE_SHIFT).select("packet_seq").collect()) == good
    late = sorted(r[0] - (1 << capture.FILE_SHIFT) for r in got.where(F.col("packet_seq") >= 1 << capture.FILE_SHIFT).select("packet_seq").collect())
    assert late == [i for i in good if i < 20] and again.count() == got.count()


def test_a_block_capture_is_refused_in_streams(tmp_path):
    (tmp_path / "a.pcap").write_bytes(struct.pack("<III", capture.NG_SECTION, 28, capture.NG_BYTE_ORDER) + bytes(16))
    reader = capture_source.CaptureStream({"path": str(tmp_path), "state": str(tmp_path / "state")})
    with pytest.raises(ValueError, match="classic"):
        reader.latestOffset()


def test_a_reader_goes_on_where_the_last_one_was(tmp_path):
    data = pcap(some_frames(50, 3))
    (tmp_path / "a.pcap").write_bytes(data[:2000])
    options = {"path": str(tmp_path), "state": str(tmp_path / "state"), "max_bytes": "700"}
    offsets = [capture_source.CaptureStream(options).latestOffset() for _ in range(3)]
    (tmp_path / "a.pcap").write_bytes(data)
    offsets += [capture_source.CaptureStream(options).latestOffset() for _ in range(20)]
    ends = [next(iter(o["files"].values()))[1] for o in offsets]
    assert ends == sorted(ends) and ends[-1] == len(data) and offsets[-1]["files"].popitem()[1] == [0, len(data), 50]


def test_frames_are_counted_in_flight(spark, captures):
    decoded = decode_frames(capture.capture_scan(spark, f"{captures}/in/*.pcap"))
    rows, seen = counted_frames(decoded)
    assert packets_of(rows).count() == seen.get["parsed"] < 600
    assert seen.get == decode_stats(decoded).first().asDict()
