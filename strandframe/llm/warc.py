"""WARC archives with revisit records and a two-level capture index.

``write_archives`` gives every page a record, compressed on its own, in archive files of the shared folder.
Of the records with equal payloads the one with the largest page_id is the response; the others are
revisits that point to it. Each task writes files of its own attempt and reports (file, offset, length) of
every record, so a lost or repeated task leaves at most files that nobody refers to.

``build_index`` range-partitions the captures by reversed-host url key (and page_id, so that a key of a
third of all rows is split), sorts them, and packs each partition into an index file of compressed blocks of ``BLOCK`` lines,
closed by its sparse directory of one entry a block. ``search`` finds the captures of any number of urls: the index files that
may hold a key by binary search over their first keys (one row a file), then, in one task for each index file, the block by
binary search in its directory, and the line by binary search in the block, which is a range read. ``records_of`` reads the records
in file order, neighbouring ranges joined. ``archive_round_trip`` asks for the urls of all pages; ``lookup`` for a few;
``read_archives`` walks all blocks without a search.

Files are opened by their uri (file, hdfs, s3, gs) on the executors. Nulls and edges: null html is an empty
payload; a null url has the empty key; payloads under ``min_bytes`` are never revisits; rows that repeat the
largest page_id of a payload are all responses; a null page_id counts as smaller than any. Empty table: no
files, empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, attach_by_key, shuffle_parts

#: Lines of an index block, bytes after which an archive file is closed, bytes that one range read joins.
BLOCK = 256
FILE_BYTES = 1 << 30
READ_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
CAPTURE = "key string, page_id long, url string, file string, offset long, length long, record_type string, payload_digest string"


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://www.a.org:80/x?y`` gives ``org,a,www)/x?y``."""
    url = (url or "").replace("\t", "%09").replace("\n", "%0A")
    if "://" not in url:
        return url
    rest = url.split("://", 1)[1].split("#", 1)[0]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    name, _, port = host.partition(":")
    shown = "" if port in ("", "80", "443") else ":" + port
    return ",".join(reversed(name.split("."))) + shown + ")" + (path if path.startswith("/") else "/" + path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, payload_digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit keeps the HTTP header (with the full length), not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one uncompressed record, with ``http`` and ``payload``; checks lengths and a response's digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    out = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
    block = rest[: int(out["content-length"])]
    if len(block) != int(out["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    out["payload_bytes"] = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
    out["payload"] = payload
    if out["warc-type"] == "response" and (len(payload) != out["payload_bytes"] or "sha1:" + digest(payload) != out["warc-payload-digest"]):
        raise ValueError("a record does not match its digest")
    return out


def page_of(record_uri: str | None):
    tail = (record_uri or "<urn:page:none>")[len("<urn:page:") : -1]
    return None if tail == "none" else int(tail)


class _Writer:
    """Archive or index files of one task attempt; rolls over at ``limit`` bytes."""

    def __init__(self, folder: str, suffix: str, limit: int):
        self.folder, self.suffix, self.limit, self.out, self.at = folder, suffix, limit, None, 0

    def write(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= self.limit:
            self.close()
            ctx = TaskContext.get()
            self.uri = f"{self.folder}/part-{ctx.partitionId() if ctx else 0:06d}-{uuid.uuid4().hex}{self.suffix}"
            fs, path = pafs.FileSystem.from_uri(self.uri)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.at = fs.open_output_stream(path, compression=None), 0
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return self.uri, at

    def close(self):
        if self.out is not None:
            self.out.close()
            self.out = None


class _Reader:
    """Range reads, with the last file kept open."""

    def __init__(self):
        self.uri = self.file = None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            fs, path = pafs.FileSystem.from_uri(uri)
            self.uri, self.file = uri, fs.open_input_file(path)
        self.file.seek(offset)
        data = self.file.read(length)
        if len(data) != length:
            raise OSError(f"{uri} ends before {offset + length}")
        return data


def _digests(batches):
    for b in batches:
        pay = [(x or "").encode() for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([len(x) for x in pay], pa.int64()), pa.array(map(digest, pay), pa.string())], [*b.schema.names[1:], "n", "digest"])


def write_archives(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html); returns the captures, stored."""
    page = F.col("page_id").cast("long")
    light = scratch.store(pages.select("html", page.alias("page_id")).mapInArrow(_digests, "page_id long, n long, digest string"), "digests")
    latest = light.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    full = pages.select("html", page.alias("page_id"), "url", F.col("html").alias("body")).mapInArrow(_digests, "page_id long, url string, body string, n long, digest string")
    rows = attach_by_key(full, latest.drop("copies"), "digest", ["page_id"], seen=light)
    revisit = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    rows = rows.select("page_id", "url", "body", "digest", F.when(revisit, F.col("latest")).alias("refers"), revisit.alias("revisit"))
    folder = scratch.path("archives")

    def write(batches):
        to = _Writer(folder, ".warc.gz", FILE_BYTES)
        for b in batches:
            out = []
            for page_id, url, body, sha, refers, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = gzip.compress(record(page_id, url, (body or "").encode(), sha, refers, again), 6, mtime=0)
                uri, at = to.write(data)
                out.append((url_key(url), page_id, url, uri, at, len(data), "revisit" if again else "response", sha))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], CAPTURE.replace(",", "").split()[::2])
        to.close()

    return scratch.store(rows.mapInArrow(write, CAPTURE), "captures")


DIRECTORY = "first_key string, last_key string, n int, file string, offset long, length long, dir_offset long, dir_length long"


def build_index(captures: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Write the sorted, compressed blocks with the directory of each file behind them; returns all entries, stored."""
    folder = scratch.path("index")
    order = ["key", "page_id", "file", "offset"]
    dealt = captures.repartitionByRange(shuffle_parts(captures.sparkSession), *order).sortWithinPartitions(*order)

    def pack(batches):
        to, held, out = _Writer(folder, ".cdx.z", 1 << 62), [], []

        def flush():
            data = zlib.compress("\n".join(f"{k}\t{json.dumps(x)}" for k, x in held).encode(), 6)
            uri, at = to.write(data)
            out.append((held[0][0], held[-1][0], len(held), uri, at, len(data)))
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append((row[0], row[1:]))
                if len(held) == block:
                    flush()
        if held:
            flush()
        tail = (0, 0)
        if out:
            data = zlib.compress("\n".join(json.dumps([x[0], x[1], x[4], x[5]]) for x in out).encode(), 6)
            tail = (to.write(data)[1], len(data))
        to.close()
        columns = list(zip(*((*x, *tail) for x in out), strict=True)) if out else [[]] * 8
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], DIRECTORY.replace(",", "").split()[::2])

    return scratch.store(dealt.mapInArrow(pack, DIRECTORY), "directory")


def _entries(data: bytes) -> tuple[list[str], list[list]]:
    """Keys and captures of one block."""
    lines = zlib.decompress(data).decode().split("\n")
    keys, values = zip(*(x.split("\t", 1) for x in lines), strict=True)
    return list(keys), [json.loads(v) for v in values]


_RANGE = "file string, offset long, length long"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _range_batch(out: list) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "offset", "length"])


def _located(batches):
    """(file, offset, length, record) for rows of ranges, in their order; neighbouring ranges are one read."""
    at = _Reader()
    for b in batches:
        where, k = list(zip(*(c.to_pylist() for c in b.columns[:3]), strict=True)), 0
        while k < len(where):
            uri, start, length = where[k]
            end, stop = start + length, k + 1
            while stop < len(where) and where[stop][0] == uri and where[stop][1] == end and end + where[stop][2] - start <= READ_BYTES:
                end += where[stop][2]
                stop += 1
            data = at.read(uri, start, end - start)
            for _, offset, n in where[k:stop]:
                yield parse(gzip.decompress(data[offset - start : offset - start + n]))
            k = stop


def _in_file_order(ranges: DataFrame) -> DataFrame:
    return ranges.select("file", "offset", "length").repartitionByRange(shuffle_parts(ranges.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")


def records_of(ranges: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records at ``ranges``."""

    def run(batches):
        for b in batches:
            out = [(page_of(r["warc-record-id"]), r["payload_bytes"], r["warc-payload-digest"][5:], r["warc-type"], page_of(r.get("warc-refers-to"))) for r in _located([b])]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in _RECORD.split(", ")])

    return _in_file_order(ranges).mapInArrow(run, _RECORD)


def read_archives(directory: DataFrame) -> DataFrame:
    """``records_of`` everything, by a walk over all blocks of the index."""

    def ranges(batches):
        at = _Reader()
        for b in batches:
            out = []
            for uri, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += [(v[2], v[3], v[4]) for v in _entries(at.read(uri, offset, length))[1]]
            yield _range_batch(out)

    n = shuffle_parts(directory.sparkSession)
    return records_of(directory.select("file", "offset", "length").repartition(n).mapInArrow(ranges, _RANGE))


class Run:
    """One index file: its directory, and the captures of a key."""

    def __init__(self, reader: _Reader, file: str, offset: int, length: int):
        self.reader, self.file = reader, file
        rows = [json.loads(x) for x in zlib.decompress(reader.read(file, offset, length)).decode().split("\n")]
        self.first, self.last, self.offset, self.length = zip(*rows, strict=True)
        self.block, self.keys, self.values, self.reads = -1, [], [], 0

    def captures(self, key: str):
        """The captures of ``key``: blocks by binary search in the directory, lines by binary search in the block."""
        at = bisect_left(self.last, key)  # the first block that does not end before the key
        while at < len(self.first) and self.first[at] <= key:
            if at != self.block:
                self.keys, self.values = _entries(self.reader.read(self.file, self.offset[at], self.length[at]))
                self.block, self.reads = at, self.reads + 1
            j = bisect_left(self.keys, key)
            while j < len(self.keys) and self.keys[j] == key:
                yield self.values[j]
                j += 1
            at += 1


def search(directory: DataFrame, urls: DataFrame) -> DataFrame:
    """(file, offset, length) of the records of all captures of ``urls`` (url), whatever their number."""
    runs = directory.groupBy("file", "dir_offset", "dir_length").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect()  # one row a file
    runs.sort(key=lambda r: (r["low"], r["high"]))
    lows, highs = [r["low"] for r in runs], [r["high"] for r in runs]
    where = [(r["file"], r["dir_offset"], r["dir_length"]) for r in runs]

    def ask(batches):
        for b in batches:
            out = []
            for key in set(map(url_key, b.column(0).to_pylist())):
                # files are sorted runs of the keys: those that do not end before the key, up to those that begin after it
                out += [(k, key) for k in range(bisect_left(highs, key), bisect_right(lows, key))]
            runs_of, keys = zip(*out, strict=True) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(runs_of, pa.int32()), pa.array(keys, pa.string())], ["run", "key"])

    def find(batches):
        at, run, last = _Reader(), None, None
        for b in batches:
            out = []
            for k, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != last:
                    run, last = Run(at, *where[k]), k
                for v in run.captures(key):
                    out.append((v[2], v[3], v[4]))
                    if len(out) >= 65_536:
                        yield _range_batch(out)
                        out.clear()
            yield _range_batch(out)

    asked = urls.select("url").mapInArrow(ask, "run int, key string").distinct()
    n = shuffle_parts(directory.sparkSession)
    return asked.repartition(n, "run").sortWithinPartitions("run", "key").mapInArrow(find, _RANGE)


def lookup(spark: SparkSession, directory: DataFrame, urls: list[str]) -> DataFrame:
    """(url, page_id, record_type, payload) of all captures of ``urls``."""

    def run(batches):
        for b in batches:
            out = [(r["warc-target-uri"], page_of(r["warc-record-id"]), r["warc-type"], r["payload"].decode()) for r in _located([b])]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["url", "page_id", "record_type", "payload"])

    found = search(directory, spark.createDataFrame([(u,) for u in urls], "url string"))
    return _in_file_order(found).mapInArrow(run, "url string, page_id long, record_type string, payload string")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write and index every row of ``pages``, then find and read back the captures of all of their urls."""
    scratch = Scratch(pages.sparkSession, "warc")
    return records_of(search(build_index(write_archives(pages, scratch, min_bytes), scratch), pages))


_B32 = " || ".join(f"to_base(('0x' || substr(sha, {1 + 5 * i}, 5))::BIGINT, 32, 4)" for i in range(8))
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT body, max(page_id) AS latest FROM p GROUP BY body)
SELECT page_id, payload_bytes, translate(upper({_B32}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> latest THEN latest END AS refers_to FROM p JOIN g USING (body)
"""
