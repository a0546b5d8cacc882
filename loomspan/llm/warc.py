"""WARC archives with payload dedup, and a two-level capture index over them.

Archives hold one gzip member a record, so any record is a range read. The index has two levels: capture lines sorted by
their reversed-host URL key in compressed blocks, and a sparse directory with the first key and the place of each block.
A lookup binary-searches the directory, reads the few blocks that can hold the key, and then reads the record's range.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan import scratch

#: Payloads of fewer bytes are always stored; capture lines in a block of the index.
LEAST_BYTES, BLOCK_LINES = 1000, 512
_HEAD, _END = b"WARC/1.1\r\n", b"\r\n\r\n"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed and joined by commas, then ) and the path with its query, lower-cased.

    Scheme, user, port, a leading www and the fragment don't count. Null gives the empty key.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"#.*$", ""), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(plain, r"^([^/?]*)", 1), r"^[^@]*@", ""), r"(:\d*)$", "")
    host = F.regexp_replace(host, r"^www\d*\.", "")
    rest = F.regexp_extract(plain, r"^[^/?]*(.*)$", 1)
    return F.when(plain == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest)))


def judge(pages: DataFrame) -> DataFrame:
    """(page_id, digest, bytes, refers_to) per distinct row: refers_to is the page whose equal payload is stored, or null."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    held = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("bytes"))
    held = scratch.materialize(held.distinct(), "payloads")
    big = held.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest", "bytes").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n"))
    # only payloads of several pages are joined, from a written table, so that a payload of very many pages can be split
    several = scratch.materialize(big.where("n > 1").select(F.col("digest").alias("_d"), F.col("bytes").alias("_b"), "kept"), "shared-payloads")
    held = held.join(several, (F.col("digest") == F.col("_d")) & (F.col("bytes") == F.col("_b")), "left")
    refers = F.when(F.col("kept") != F.coalesce("page_id", F.col("kept") - 1), F.col("kept"))
    return held.select("page_id", "digest", "bytes", refers.alias("refers_to"))


def _record(page_id: int | None, url: str, digest: str, n: int, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC record: an HTTP response, or its head alone in a revisit. Digest and HTTP length are of the full payload.

    Record ids are unique. Page ids stand in fields of our own, which other readers pass over.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {n}\r\n\r\n".encode()
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "X-Page-ID": "" if page_id is None else page_id,
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-ID": refers_to}
    fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": len(http) + len(payload)}
    return _HEAD + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items()) + b"\r\n" + http + payload + _END


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of one record, those of the HTTP head in its block, and the payload behind it."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != _HEAD.decode().strip():
        raise ValueError("not a WARC record")
    named = lambda some: dict(line.split(": ", 1) for line in some)
    fields = named(lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != _END:
        raise ValueError("the record's length is wrong")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, named(http.decode().split("\r\n")[1:]), payload


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of pages (page_id, url, html) to archives under folder; returns the captures.

    (key, page_id, url, digest, path, offset, length) per record. Each task writes an archive of its own name, and only
    tasks that end well name theirs in the captures.
    """
    judged = judge(pages)
    # a page's refers_to goes to its row by page_id and digest; payloads of revisits are dropped before anything else
    held = pages.select("page_id", "url", "html", url_key(F.col("url")).alias("key"), F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"))
    judged = judged.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "bytes", "refers_to")
    held = held.join(judged, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")))
    held = held.select("key", "page_id", F.coalesce("url", F.lit("")).alias("url"), "digest", "bytes", "refers_to", F.when(F.col("refers_to").isNull(), F.coalesce("html", F.lit(""))).otherwise("").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, at = None, "", 0
        for batch in batches:
            if out is None and batch.num_rows:
                path = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz"
                fs, local = FileSystem.from_uri(path)
                fs.create_dir(local.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(local, compression=None)
            offsets, lengths = [], []
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "digest", "bytes", "refers_to", "html")), strict=True):
                page_id, url, digest, n, refers_to, html = (x.as_py() for x in row)
                data = _gzip(_record(page_id, url, digest, n, refers_to, html.encode("utf-8", "surrogatepass")))
                out.write(data)
                offsets.append(at)
                lengths.append(len(data))
                at += len(data)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "page_id", "url", "digest")), pa.array([path] * batch.num_rows, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                ["key", "page_id", "url", "digest", "path", "offset", "length"],
            )
        if out is not None:
            out.close()

    return scratch.materialize(held.mapInArrow(run, "key string, page_id bigint, url string, digest string, path string, offset bigint, length bigint"), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the two-level index of captures under folder; returns its parts (part, path, first, last, lines).

    Captures are range-partitioned and sorted by key; each part is one file of gzip blocks with its block directory at
    the end. The table of parts is the top of the directory: one row a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, path, at, lines, first, last, total = None, 0, "", 0, [], "", "", 0
        directory: list[tuple[str, int, int]] = []

        def flush() -> None:
            nonlocal at, lines
            if lines:
                data = _gzip("\n".join(json.dumps(x) for x in lines).encode())
                directory.append((lines[0][0], at, len(data)))
                out.write(data)
                at, lines = at + len(data), []

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    part, first, path = row["part"], row["key"], f"{folder}/index-{row['part']:06d}-{uuid.uuid4().hex[:8]}.idx"
                    fs, local = FileSystem.from_uri(path)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(local, compression=None)
                last, total = row["key"], total + 1
                lines.append([row["key"], row["page_id"], row["digest"], row["path"], row["offset"], row["length"]])
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            flush()
            tail = _gzip(json.dumps(directory).encode())
            out.write(tail + len(tail).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, path, first, last, total)], ["part", "path", "first", "last", "lines"])

    n = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id").withColumn("part", F.spark_partition_id().cast("bigint"))
    return scratch.materialize(ordered.mapInArrow(run, "part bigint, path string, first string, last string, lines bigint"), "index-parts")


class IndexPart:
    """Lookups in one file of the index; holds the block directory and the last block."""

    def __init__(self, path: str):
        fs, local = FileSystem.from_uri(path)
        self.file = fs.open_input_file(local)
        size = self.file.size()
        n = int.from_bytes(self._range(size - 8, 8), "little")
        self.blocks = json.loads(zlib.decompress(self._range(size - 8 - n, n), 31))
        self.keys = [b[0] for b in self.blocks]
        self.held: tuple[int, list] = (-1, [])

    def _range(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def _block(self, k: int) -> list:
        if self.held[0] != k:
            _, start, length = self.blocks[k]
            self.held = (k, [json.loads(line) for line in zlib.decompress(self._range(start, length), 31).split(b"\n")])
        return self.held[1]

    def lookup(self, key: str) -> Iterator[list]:
        """Capture lines with this key: [key, page_id, digest, path, offset, length]."""
        k = max(0, bisect.bisect_left(self.keys, key) - 1)
        while k < len(self.keys) and self.keys[k] <= key:
            block = self._block(k)
            i = bisect.bisect_left(block, key, key=lambda line: line[0])
            while i < len(block) and block[i][0] == key:
                yield block[i]
                i += 1
            k += 1


def read_pages(keys: DataFrame, parts: DataFrame) -> DataFrame:
    """Look distinct keys (column key) up in the index and read the records they lead to.

    (page_id, url, record_type, payload_bytes, payload_digest, refers_to) per record. A response's length and digest are
    those of the payload read; a revisit's are those its record states of the full payload. Each index part is read by
    the tasks that the keys in its range are dealt to; captures, not keys, are then dealt evenly for the range reads.
    """
    # the top of the directory has one row a file, as many as there were tasks
    top = sorted((r.first, r.last, r.path) for r in parts.toLocalIterator())
    firsts = [r[0] for r in top]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                k = bisect.bisect_right(firsts, key) - 1
                while k >= 0 and top[k][1] >= key:  # a key that fills parts is in each of them
                    rows.append((top[k][2], key))
                    k -= 1
            yield _columns(rows, ["path", "key"], [pa.string(), pa.string()])

    routed = keys.select("key").mapInArrow(route, "path string, key string")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, IndexPart | None] = ("", None)
        for batch in batches:
            found = []
            for path, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held[0] != path:
                    held = (path, IndexPart(path))
                found += [line[3:6] for line in held[1].lookup(key)]
                if len(found) >= 10_000:
                    yield _columns(found, ["path", "offset", "length"], [pa.string(), pa.int64(), pa.int64()])
                    found = []
            yield _columns(found, ["path", "offset", "length"], [pa.string(), pa.int64(), pa.int64()])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file = "", None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held != path:
                    fs, local = FileSystem.from_uri(path)
                    held, file = path, fs.open_input_file(local)
                file.seek(offset)
                fields, http, payload = parse_record(zlib.decompress(file.read(length), 31))
                number = lambda text: int(text) if text else None
                stored = fields["WARC-Type"] == "response"
                digest = hashlib.sha1(payload).hexdigest() if stored else base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2]).hex()
                n = len(payload) if stored else int(http["Content-Length"])
                rows.append((number(fields["X-Page-ID"]), unquote(fields["WARC-Target-URI"]), fields["WARC-Type"], n, digest, number(fields.get("X-Refers-To-Page-ID"))))
            yield _columns(rows, ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"], [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()])

    sorted_keys = routed.repartitionByRange("path", "key").sortWithinPartitions("path", "key")
    places = sorted_keys.mapInArrow(find, "path string, offset bigint, length bigint")
    places = places.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    return places.mapInArrow(read, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint")


def _columns(rows: list, names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def archive_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive all pages, index them, and read every page back through the index.

    Of equal payloads of LEAST_BYTES or more the one with the largest page_id is stored; rows that repeat that id are
    stored too. A null html is an empty payload, a null url has the empty key, and a null page_id is never referred to
    while another page has the payload. Extra columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = folder or scratch.new_path(spark, "warc")
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    captures = write_archives(pages, folder)
    parts = write_index(captures, folder)
    return read_pages(captures.select("key").distinct(), parts)
