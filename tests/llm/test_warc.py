import base64
import gzip
import hashlib
import os
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tidewire.llm import warc

LONG = "<p>" + "same words again " * 80 + "</p>"


def expected(rows):
    """(page_id, bytes, digest, type, refers_to) by a plain pass over all rows."""
    first, out = {}, []
    for key, url, html in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True):
        body = (html or "").encode()
        sha1 = hashlib.sha1(body).hexdigest()
        if len(body) < warc.LEAST or body not in first:
            first.setdefault(body, key)
            out.append((key, len(body), sha1, "response", None))
        else:
            out.append((key, len(body), sha1, "revisit", first[body]))
    return Counter(out)


def read(spark, manifest):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, manifest).collect())


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"http://a.example/{i}", LONG if i % 3 == 0 else f"<p>{i} é</p>" * (1 + i * 7)) for i in range(60)]
    out += [(100, None, None), (101, "http://a.example/ü b\r\nX: y", ""), (None, "u", LONG), (None, None, "no key" * 300), (7, "http://a.example/7", "other" * 400)]
    return out + [(5, "twice", "twice" * 300)] * 3 + [(None, None, None)] * 2 + [(8, "long", "z" * 3_000_000)]


SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("shards", [1, 5, 40])
def test_round_trip(spark, tmp_path, rows, shards):
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS hash", "1 AS shard", "'y' AS body", "2 AS key")
    manifest = warc.write_archives(pages.repartition(3), str(tmp_path / "w"), shards=shards)
    assert read(spark, manifest) == expected(rows)
    assert not (tmp_path / "w" / "_temporary").exists()
    found = warc.read_archives(spark, manifest, payload=True).where("record_type = 'response'").collect()
    want = {hashlib.sha1((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in rows}
    assert all(bytes(r.payload) == want[r.payload_digest] for r in found)
    urls = {r.url for r in warc.read_archives(spark, manifest).collect()}
    assert "http://a.example/%C3%BC%20b%0D%0AX:%20y" in urls and None in urls and "http://a.example/7" in urls


def test_equal_bytes_whatever_the_order(spark, tmp_path, rows):
    one = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "a"), shards=2)
    two = warc.write_archives(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), str(tmp_path / "b"), shards=2)
    bytes_of = [sorted((r.shard, r.roll, r.sha256) for r in m.collect()) for m in (one, two)]
    assert bytes_of[0] == bytes_of[1]


def test_rolls_by_compressed_size(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", base64.b64encode(os.urandom(3000)).decode()) for i in range(200)], SCHEMA)
    manifest = warc.write_archives(pages, str(tmp_path / "w"), shards=2, roll_bytes=50_000).collect()
    assert len(manifest) > 6
    for r in manifest:
        assert os.path.getsize(r.name) == r.bytes and r.bytes < 50_000 + 6000
        with open(r.name, "rb") as file:
            data = file.read()
        assert hashlib.sha256(data).hexdigest() == r.sha256
        assert gzip.decompress(data).count(b"WARC-Type: response") == r.records == r.responses
    full = Counter(r.shard for r in manifest if r.bytes >= 50_000)
    assert all(full[s] == n - 1 or full[s] == n for s, n in Counter(r.shard for r in manifest).items())


def test_files_of_lost_attempts_are_not_read(spark, tmp_path, rows):
    path = tmp_path / "w"
    (path / "_temporary").mkdir(parents=True)
    (path / "_temporary" / "part-000000-0000.warc.gz.999").write_bytes(b"half a file")
    (path / "part-000009-0000.warc.gz").write_bytes(b"not committed")
    assert read(spark, warc.write_archives(spark.createDataFrame(rows, SCHEMA), str(path), shards=3)) == expected(rows)
    assert pq.read_table(path / "manifest").num_rows == 3


def test_moving_again_changes_nothing(spark, tmp_path, rows):
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w"), shards=3)
    batch = manifest.selectExpr("concat(name, '.gone') AS temporary", "name", "bytes").toArrow().to_batches()
    assert sum(b.num_rows for b in warc.moved(iter(batch))) == 3


def test_damage_is_found(spark, tmp_path, rows):
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w"), shards=1)
    name = manifest.first().name
    with gzip.open(name) as file:
        data = file.read()
    with gzip.open(name, "wb") as file:
        file.write(data.replace(b"same words again", b"same words agaim", 1))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, manifest).collect()


def test_empty_and_one_crowded_payload(spark, tmp_path):
    assert read(spark, warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))) == Counter()
    rows = [(i // 4, "u", LONG) for i in range(400)] + [(i, "v", None) for i in range(400)]
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(5), str(tmp_path / "w"), shards=8)
    got = read(spark, manifest)
    assert got == expected(rows) and max(r.records for r in manifest.collect()) < 200
