"""Cases at the edges: missing times, protocol 0, fragments, label files of unlike sizes, IPv6 networks."""

import pytest
from pyspark.sql import functions as F

from tidewire.functions import decode as D
from tidewire.functions.packets import net
from tidewire.functions.scalar import parse_port
from tidewire.operators import labels as LA
from tidewire.operators import model as MO
from tidewire.operators import prepare as P
from tidewire.operators.split import time_split
from tidewire.schemas import FEATURE_NAMES, PACKETS
from tidewire.sources import tables as TB
from tidewire.streaming import flows as SF


def test_rows_without_a_time_come_last(spark):
    rows = [(i, None if i % 4 == 0 else float("nan") if i % 4 == 1 else float(i), i % 2) for i in range(1000)]
    table = spark.createDataFrame(rows, "id int, start_time double, label int")
    sides = time_split(table, 0.25, ["id"]).collect()
    assert len(sides) == 1000 and sum(r.is_test for r in sides) == 250 and not any(r.is_test is None for r in sides)
    assert all(r.start_time is None or r.start_time != r.start_time for r in sides if r.is_test)


def test_protocol_zero_is_kept_in_streams(spark, tmp_path):
    rows = [(i, 1_000_000 * (i + 1), "10.0.0.1", "10.0.0.2", 1, 2, 0 if i % 2 else 17, 60, 10, 0, bytearray(b"x")) for i in range(10)]
    spark.createDataFrame(rows, PACKETS).write.parquet(str(tmp_path / "in"))
    stream = SF.assign_flow_stream(SF.packet_stream(spark, str(tmp_path / "in")))
    SF.heartbeat(spark, str(tmp_path / "in"), 10_000_000_000)
    progress = SF.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).where("kind = 'packet'")
    assert got.count() == 10 and progress.batches >= 1 and progress.rows == 11


def test_a_stream_stops_after_enough_packets(spark, tmp_path):
    rows = [(i, 1_000_000 * (i + 1), "10.0.0.1", "10.0.0.2", 1, 2, 17, 60, 10, 0, bytearray(b"x")) for i in range(20)]
    spark.createDataFrame(rows, PACKETS).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = SF.packet_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    few = SF.run_for(stream, str(tmp_path / "few"), str(tmp_path / "cp1"), packets=6, seconds=60)
    assert 6 <= few.rows < 20 and spark.read.parquet(str(tmp_path / "few")).count() >= 6
    brief = SF.run_for(stream, str(tmp_path / "brief"), str(tmp_path / "cp2"), seconds=1)
    assert brief.rows <= 20


def test_the_last_label_file_wins(spark, tmp_path):
    (tmp_path / "a.csv").write_text("flow_id,label\nX,benign\nY,c2\n")
    (tmp_path / "b.csv").write_text("flow_id,label\n" + "".join(f"Z{i},benign\n" for i in range(5000)) + "X,c2\n")
    (tmp_path / "c.csv").write_text("label,flow_id\nbenign,Y\n")
    found = {r.flow_id: r.label for r in LA.last_labels(TB.label_table_scan(spark, str(tmp_path / "*.csv"))).where("flow_id in ('X', 'Y')").collect()}
    assert found == {"X": 1, "Y": 0}


def test_headers_of_many_files(spark, tmp_path, monkeypatch):
    for i in range(9):
        (tmp_path / f"f{i}.csv").write_text(("a,b\n" if i % 2 else "b,c\n") + f"{i},x\n")
    paths = [str(tmp_path / f"f{i}.csv") for i in range(9)]
    few = TB.read_headers(spark, paths)
    monkeypatch.setattr(TB, "FEW_FILES", 2)
    assert TB.read_headers(spark, paths) == few == [["a", "b"] if i % 2 else ["b", "c"] for i in range(9)]
    assert TB.scan_text(spark, paths).count() == 9


def test_later_fragments_hold_no_transport_header(spark):
    def frame(offset):
        ip = bytes([0x45, 0, 0, 40, 0, 1, offset >> 8, offset & 255, 64, 17, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2])
        return bytearray(b"\0" * 12 + b"\x08\x00" + ip + b"\x01\x02\x03\x04" + b"\0" * 16)

    rows = [(0, 1, 54, frame(0x2000)), (1, 2, 54, frame(0x2003)), (2, 3, 54, frame(0x0003)), (3, 4, 54, frame(0))]
    frames = spark.createDataFrame([(a, b, 1, d) for a, b, c, d in rows], "packet_seq long, ts_us long, linktype int, frame binary")
    status = {r.packet_seq: r.decode_status for r in D.decode_frames(frames).collect()}
    assert status[0] == status[3] == D.OK and status[1] == status[2] == D.SKIPPED_L4


def test_networks_of_both_families(spark):
    rows = [("2001:db8::1", "fe80::1"), ("2001:db9::1", "::1"), ("10.1.2.3", "10.9.9.9"), ("2001:DB8:0:0:0:0:0:5", "::")]
    packets = spark.createDataFrame(rows, "src_ip string, dst_ip string")
    assert [r.src_ip for r in packets.where(net("2001:db8::/32")).collect()] == ["2001:db8::1", "2001:DB8:0:0:0:0:0:5"]
    assert packets.where(net("fe80::/10")).count() == 1 and packets.where(net("::1/128")).count() == 1
    assert packets.where(net("10.0.0.0/9")).count() == 1


def test_ports_in_long_hex(spark):
    rows = [("0x50",), ("0x" + "0" * 30 + "1bb",), ("0x1" + "0" * 16,)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(parse_port(F.col("p"))).collect()]
    assert got == [80.0, 443.0, float(16 ** 16)]


def test_training_refuses_bad_features_and_preparation_without_attacks(spark):
    good = [(*[float(i + j) for j in range(len(FEATURE_NAMES))], i % 2) for i in range(8)]
    bad = [(*[float("nan")] * len(FEATURE_NAMES), 1)]
    schema = ", ".join(f"{n} double" for n in FEATURE_NAMES) + ", label int"
    with pytest.raises(Exception, match="non-finite"):
        MO.train(spark.createDataFrame(good + bad, schema), MO.forest(trees=1, depth=2))
    with pytest.raises(ValueError, match="attack"):
        P.require_attacks(spark.createDataFrame([(0,)], "label int"))
