"""WARC archives written and read by Spark tasks: sorted shards, files rolled by compressed size, a manifest as the commit.

Records are range-sorted by the SHA-256 of their payload, then by key. Digests are evenly spread, so the borders of the ranges
are known beforehand, and equal payloads lie beside each other: the first of a run is the response that the others revisit.
A payload that is more than a shard's share of all rows is dealt over all shards instead; its response is worked out before,
and only that one row carries the payload. There are fewer such payloads than shards.

A task writes to temporary names that carry its attempt, one gzip member a record, and starts a new file when the compressed
size reaches `roll_bytes`. The files of the attempts that Spark committed are moved to their final names by tasks; the manifest,
a Parquet table, is written last, and readers open nothing that it does not list. Headers, record ids and digests are made anew
from the rows, so equal tables give equal bytes, whatever the order or partitioning of the rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import partitions, release, slices, stored
from tidewire.sources.capture import file_system

#: Payloads of at least this many bytes are stored once.
LEAST = 1000
#: Payload bytes of a shard; compressed bytes at which a new file starts; records are dated alike, as tables bring no time.
SHARD_BYTES, ROLL_BYTES, DATE = 128 << 20, 256 << 20, "1970-01-01T00:00:00Z"

# --- fixed values: the format ---
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))

FILES = "shard int, roll int, temporary string, name string, bytes long, records long, responses long, sha256 string"


def record_id(*parts: str | int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(map(repr, parts)))}>"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(headers: list[tuple[str, str | None]], block: bytes, level: int) -> bytes:
    """One record as a gzip member without a time of its own. Headers without a value are left out."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def safe(text: str | None, keep: str = PRINTABLE) -> str | None:
    """Blanks, control and other characters a header cannot hold, percent-encoded."""
    return None if text is None else quote(text, safe=keep)


class Roll:
    """The files of one task."""

    def __init__(self, path: str, shard: int, attempt: int, roll_bytes: int, level: int):
        self.path, self.shard, self.attempt, self.most, self.level = path.rstrip("/"), shard, attempt, roll_bytes, level
        self.out, self.done = None, []

    def add(self, data: bytes, responses: int) -> None:
        if self.out is None:
            name = f"part-{self.shard:06d}-{len(self.done):04d}.warc.gz"
            self.temporary = f"{self.path}/_temporary/{name}.{self.attempt}"
            system, inner = file_system(self.temporary)
            system.create_dir(inner.rpartition("/")[0], recursive=True)
            self.out, self.name, self.size, self.records, self.responses, self.hash = system.open_output_stream(inner, compression=None), name, 0, 0, 0, hashlib.sha256()
            self.put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("file", name)), ("WARC-Date", DATE), ("WARC-Filename", name),
                             ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", self.level))
        self.put(data)
        self.records += 1
        self.responses += responses
        if self.size >= self.most:
            self.close()

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, len(self.done), self.temporary, f"{self.path}/{self.name}", self.size, self.records, self.responses, self.hash.hexdigest()))
            self.out = None


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, date: str = DATE,
                   shards: int | None = None, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = 6) -> DataFrame:
    """Writes a record for every row and returns the manifest, a row for each file, which is also kept at `path`/manifest.

    The payload is the html, in UTF-8 if it is a string; null is empty. Of rows with equal payloads of `least` bytes or more
    the one of the largest key (null keys come last; then the largest url; of rows alike in all three, one) is the response,
    the others revisit it. Smaller payloads are all responses. Null keys and urls have no header. Urls keep their printable
    ASCII; other characters are percent-encoded. Other columns are not read. An empty table has an empty manifest. A very
    long payload is one record of one member, held by its task alone. `pages` has to give the same rows whenever it is worked
    out, as it is read twice; what was written is counted against what was read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b"")).alias("body"), F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("hash", F.sha2("body", 256))
    groups = stored(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("body")).cast("long").alias("n"),
                                             F.max(F.struct("key", "url", (-F.col("place")).alias("place"))).alias("head")), "payloads")
    total = groups.agg(F.sum("copies").alias("rows"), F.sum(F.col("copies") * F.col("n")).alias("bytes"),
                       F.sum(F.when(F.col("n") >= least, F.lit(1)).otherwise(F.col("copies"))).alias("responses")).first()
    shards = shards or max(partitions(spark), -(-(total["bytes"] or 0) // shard_bytes))

    def spread(place):
        return F.pmod(F.xxhash64(place), F.lit(shards)).cast("int")

    crowded = groups.where(F.col("copies") > (total["rows"] or 0) // shards + 1).select("hash", F.lit(True).alias("crowded"), F.struct("head.key", "head.url").alias("head"), (-F.col("head.place")).alias("first"))
    placed = rows.join(F.broadcast(crowded), "hash", "left")             # fewer rows than shards
    first = F.coalesce(F.col("place") == F.col("first"), F.lit(False))
    slot = F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * shards / F.lit(1 << 32)).cast("int")
    placed = placed.select(
        "hash", F.col("key").cast("string").alias("id"), "key", "url", F.octet_length("body").cast("long").alias("n"), F.sha1("body").alias("sha1"), first.alias("first"),
        F.when(first | F.col("crowded").isNull() | (F.octet_length("body") < least), F.col("body")).alias("body"),
        F.when(F.col("crowded").isNotNull(), F.struct(F.col("head.key").cast("string").alias("id"), F.col("head.url").alias("url"))).alias("head"),
        F.when(F.col("crowded").isNull(), slot).otherwise(spread(F.col("place"))).alias("shard"))
    order = ["hash", F.desc("first"), F.desc_nulls_last("key"), F.desc_nulls_last("url")]
    dealt = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions(*order).select("hash", "id", "url", "n", "sha1", "first", "body", "head", "shard")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, last, repeat, head = None, None, 0, (None, None)
        for part in slices(batches, "body"):
            for hash_, id_, url_, n, sha1, first_, body, crowd, shard in zip(*(c.to_pylist() for c in part.columns)):
                if roll is None:
                    roll = Roll(path, shard, TaskContext.get().taskAttemptId(), roll_bytes, level)
                new = last is None or last[0] != hash_
                repeat = repeat + 1 if last == (hash_, id_, url_) else 0
                last = (hash_, id_, url_)
                if new:
                    head = (id_, url_) if crowd is None else (crowd["id"], crowd["url"])
                once = n >= least
                response = not once or (new if crowd is None else first_)
                own = ("response", hash_, id_, url_) if once and response else ("copy", hash_, id_, url_, shard, repeat)
                lines = [("WARC-Type", "response" if response else "revisit"), ("WARC-Record-ID", record_id(*own)), ("WARC-Date", date), ("WARC-Target-URI", safe(url_)),
                         ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()), ("X-Page-Id", safe(id_, ""))]
                block = HTTP.format(n).encode() + (body if response else b"")
                lines += [("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
                if not response:
                    lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", hash_, *head)), ("WARC-Refers-To-Date", date),
                              ("WARC-Refers-To-Target-URI", safe(head[1])), ("X-Refers-To-Page-Id", safe(head[0], ""))]
                roll.add(member(lines, block, level), int(response))
        if roll is not None:
            roll.close()
            if roll.done:
                kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
                fields = [f.split() for f in FILES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*roll.done), fields)], [n for n, _ in fields])

    pending = stored(dealt.mapInArrow(write, FILES), "pending")
    committed = pending.repartition(partitions(spark), "name").mapInArrow(moved, FILES)
    committed.select(*[c for c in pending.columns if c != "temporary"]).write.parquet(f"{path.rstrip('/')}/manifest")
    manifest = spark.read.parquet(f"{path.rstrip('/')}/manifest")
    got = manifest.agg(F.sum("records").alias("rows"), F.sum("responses").alias("responses")).first()
    if (got["rows"], got["responses"]) != (total["rows"], total["responses"]):
        raise RuntimeError(f"{total} were to be written, {got} were: the input changed between two readings")
    system, inner = file_system(f"{path.rstrip('/')}/_temporary")
    if system.get_file_info(inner).type.name == "Directory":            # what lost attempts have left
        system.delete_dir(inner)
    return manifest


def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files get their final names; a task that runs again finds them moved."""
    for batch in batches:
        for temporary, name, size in zip(*(batch.column(c).to_pylist() for c in ("temporary", "name", "bytes"))):
            system, source = file_system(temporary)
            target = file_system(name)[1]
            if system.get_file_info(target).size != size:
                system.move(source, target)
        yield batch


def records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a gzipped archive; blocks are compared with their digests."""
    with gzip.GzipFile(fileobj=file) as plain:
        while line := plain.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a record: {line[:40]!r}")
            headers: dict[str, str] = {}
            while line := plain.readline().rstrip(b"\r\n"):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
            size = int(headers["content-length"])
            block = plain.read(size)
            if len(block) < size or "warc-block-digest" in headers and digest(block) != headers["warc-block-digest"]:
                raise ValueError(f"{headers.get('warc-record-id')} is damaged")
            yield headers, block


def read_archives(spark: SparkSession, names: DataFrame, key_type: str = "long", payload: bool = False) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of each response and revisit in the files.

    `names` has a column name, such as a manifest. payload_digest is SHA-1 in lower-case hex; a response's is worked out from
    its payload and has to agree with its header, a revisit's length and digest are those of its headers. The payload is null
    unless asked for, and for revisits.
    """
    kinds = [("id", pa.string()), ("url", pa.string()), ("type", pa.string()), ("n", pa.int64()), ("digest", pa.string()), ("refers", pa.string()), ("payload", pa.binary())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [k for k, _ in kinds])

        for name in (n for b in batches for n in b.column(0).to_pylist()):
            system, inner = file_system(name)
            with system.open_input_stream(inner, compression=None) as file:
                for headers, block in records(file):
                    if headers.get("warc-type") not in ("response", "revisit"):
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    sha1 = headers["warc-payload-digest"].removeprefix("sha1:")
                    if headers["warc-type"] == "response":
                        n = len(body)
                        if digest(body) != f"sha1:{sha1}":
                            raise ValueError(f"{headers['warc-record-id']}: payload and digest differ")
                    else:
                        n = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    texts = [None if x is None else unquote(x) for x in (headers.get("x-page-id"), headers.get("x-refers-to-page-id"))]
                    rows.append((texts[0], headers.get("warc-target-uri"), headers["warc-type"], n, base64.b32decode(sha1).hex(), texts[1],
                                 body if payload and headers["warc-type"] == "response" else None))
                    held += 500 + (n if payload else 0)
                    if held > 8 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()
        release()

    found = names.select("name").repartition(partitions(spark), "name").mapInArrow(read, "id string, url string, type string, n long, digest string, refers string, payload binary")
    return found.select(F.col("id").cast(key_type).alias("page_id"), "url", F.col("type").alias("record_type"), F.col("n").alias("payload_bytes"),
                        F.col("digest").alias("payload_digest"), F.col("refers").cast(key_type).alias("refers_to"), "payload")
