"""Index of sequence files by byte ranges: a task sums up the lines that begin in its range, and the sums of a record that goes on over
several ranges are merged in file order. No file, and no line, is held in memory.

The sum of a run of lines is (lines, letters, letters and bytes of the first line, letters of the last line, whether all lines but the last
have as many letters as the first and the last no more). Two such sums, one behind the other, make the sum of both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from . import blocks as B

SUM = "lines long, len long, first int, first_bytes int, last int, even boolean"
SCHEMA = f"file string, split int, k int, name string, offset long, {SUM}"
SPLIT_BYTES, CHUNK = 32 << 20, 1 << 20


def lines_of(raw, start: int, stop: int):
    """(place, bytes, letters, head) of the lines that begin in [start, stop); ``head`` is the line itself if it is a header, else None."""
    size, at = raw.size(), start
    skipping = start > 0 and raw.read_at(1, start - 1) != b"\n"
    begin, length, head, last = start, 0, None, b""
    while at < size:
        chunk = raw.read_at(min(CHUNK, size - at), at)
        k = 0
        while k < len(chunk):
            end = chunk.find(b"\n", k)
            piece = chunk[k : len(chunk) if end < 0 else end]
            if not skipping:
                if not length:
                    head = bytearray() if piece[:1] == b">" else None
                if head is not None:
                    head += piece
                length += len(piece)
                last = piece[-1:] or last
            k += len(piece)
            if end >= 0:
                k += 1
                if skipping:
                    skipping = False
                elif begin < stop:
                    yield begin, length + 1, length - (last == b"\r" and length > 0), head
                begin, length, head, last = at + k, 0, None, b""
                if begin >= stop:
                    return
        at += len(chunk)
    if not skipping and length and begin < stop:
        yield begin, length, length - (last == b"\r"), head


def merged(a, b):
    """The sum of two runs of lines, one behind the other."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    even = a[5] and b[5] and a[4] == a[2] and (b[4] <= a[2] if b[0] == 1 else b[2] == a[2])
    return a[0] + b[0], a[1] + b[1], a[2], a[3], b[4], even


NONE = (0, 0, 0, 0, 0, True)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], split_bytes: int):
        self.paths, self.split_bytes = paths, split_bytes

    def partitions(self):
        return B.ranges(self.paths, self.split_bytes)

    def read(self, part):
        with B.open_input(part.path) as raw:
            k, name, offset, own = -1, None, None, NONE
            for at, size, letters, head in lines_of(raw, part.start, part.stop):
                if head is not None:
                    yield (part.path, part.number, k, name, offset, *own)
                    words = bytes(head[1:]).split()
                    k, name, offset, own = k + 1, words[0].decode() if words else "", at + size, NONE
                elif letters:
                    own = merged(own, (1, letters, letters, size, letters, True))
            yield (part.path, part.number, k, name, offset, *own)


class SequencePartsSource(DataSource):
    @classmethod
    def name(cls):
        return "sequence_parts"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(B.files_of(self.options["path"], self.options.get("ending", "")), int(self.options.get("split_bytes", SPLIT_BYTES)))


def as_one_file(index: DataFrame, path: str, ending: str = "") -> DataFrame:
    """``index`` with offsets as if the files of ``path`` stood one behind the other, in order of their names."""
    sizes, at = [], 0
    for r in B.ranges(B.files_of(path, ending), 1 << 62):
        sizes.append((r.path, at))
        at += r.stop - r.start
    starts = index.sparkSession.createDataFrame(sizes, "file string, _start long")
    return index.join(F.broadcast(starts), "file").withColumn("offset", F.col("offset") + F.col("_start")).drop("_start")


def sequence_index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, ending: str = "") -> DataFrame:
    """(file, name, len, offset, line_bases, line_bytes) per record; lines of uneven length raise an error."""
    spark.dataSource.register(SequencePartsSource)
    parts = spark.read.format("sequence_parts").option("split_bytes", split_bytes).option("ending", ending).load(path)
    # what goes on from before belongs to the last record of the last range that has one: a row a range
    last = parts.groupBy("file", "split").agg(F.max("k").alias("_k"))
    at = F.last(F.when(F.col("_k") >= 0, F.struct(F.col("split").alias("s"), F.col("_k").alias("k"))), ignorenulls=True)
    before = last.select("file", "split", at.over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)).alias("_of"))
    more = parts.where("k < 0 AND lines > 0").join(before, ["file", "split"]).where("_of IS NOT NULL").withColumns({"_s": F.col("_of.s"), "_r": F.col("_of.k")})
    rows = parts.where("k >= 0").withColumns({"_s": F.col("split"), "_r": F.col("k")}).unionByName(more.drop("_of"))
    sums = F.array_sort(F.collect_list(F.struct("split", *[c.split()[0] for c in SUM.split(", ")])))
    g = rows.groupBy("file", "_s", "_r").agg(F.max("name").alias("name"), F.max("offset").alias("offset"), sums.alias("_p"))

    def run(batches):
        import pyarrow as pa

        types = pa.schema([("file", pa.string()), ("name", pa.string()), ("len", pa.int64()), ("offset", pa.int64()), ("line_bases", pa.int32()), ("line_bytes", pa.int32())])
        for b in batches:
            out = []
            for r in b.to_pylist():
                total = reduce(merged, (tuple(p.values())[1:] for p in r["_p"]), NONE)
                if not total[5]:
                    raise ValueError(f"lines of {r['name']} differ in length")
                out.append(dict(zip(types.names, (r["file"], r["name"], total[1], r["offset"], total[2], total[3]), strict=True)))
            yield pa.RecordBatch.from_pylist(out, types)

    return g.mapInArrow(run, "file string, name string, len long, offset long, line_bases int, line_bytes int")
