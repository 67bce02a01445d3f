import random
import struct

import pytest

from tidewire.sources import capture


def pcap(frames, order="<", nano=False):
    out = [struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
    for ts, data in frames:
        out.append(struct.pack(order + "IIII", ts // 1_000_000, ts % 1_000_000 * (1000 if nano else 1), len(data), len(data)) + data)
    return b"".join(out)


def some_frames(n, seed, longest=300):
    rng = random.Random(seed)
    return [(10 ** 15 + i * 1234, rng.randbytes(rng.choice([0, 14, 60, rng.randrange(longest)]))) for i in range(n)]


def scan(spark, path, split_bytes):
    rows = capture.capture_scan(spark, str(path), split_bytes).collect()
    return sorted((r.packet_seq, r.frame_no, r.ts_us, bytes(r.frame)) for r in rows)


def whole(frames):
    return [(i, i, ts, data) for i, (ts, data) in enumerate(frames)]


@pytest.mark.parametrize("order,nano,split_bytes", [("<", False, 700), (">", True, 1500), ("<", False, 120)])
def test_ranges_that_begin_inside_frames(spark, tmp_path, order, nano, split_bytes):
    frames = some_frames(120, 1)
    (tmp_path / "a.pcap").write_bytes(pcap(frames, order, nano))
    assert scan(spark, tmp_path / "a.pcap", split_bytes) == whole(frames)
    index = capture.capture_index(spark, [str(tmp_path / "a.pcap")], split_bytes).collect()
    assert len(index) > 3 and sorted(r.begin for r in index)[1:] == sorted(r.end for r in index)[:-1]


def test_a_capture_inside_a_capture(spark, tmp_path):
    """Payloads that are themselves long chains of records are taken for records first, and put right."""
    inner = pcap([(5, b"inner" * 4)] * 60)[24:]
    frames = [f for pair in zip(some_frames(20, 2), [(10 ** 15, inner)] * 20) for f in pair]
    (tmp_path / "a.pcap").write_bytes(pcap(frames))
    assert scan(spark, tmp_path / "a.pcap", 900) == whole(frames)


def test_files_cut_off_or_empty(spark, tmp_path):
    frames = some_frames(50, 3)
    data = pcap(frames)
    (tmp_path / "cut.pcap").write_bytes(data[:-5] if frames[-1][1] else data[:-3])
    assert scan(spark, tmp_path / "cut.pcap", 600) == whole(frames[:-1])
    (tmp_path / "none.pcap").write_bytes(data[:24])
    assert scan(spark, tmp_path / "none.pcap", 600) == []
