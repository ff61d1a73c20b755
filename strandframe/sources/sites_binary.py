"""Binary site format: block-compressed records of site strings and typed sample blocks; data source for reads (a task a file) and
writes (each task streams its partition to a file, see ``blocks.FileWriter``)."""

from __future__ import annotations

import gzip
import io
import json
import struct
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .blocks import FileWriter, Writer, files_of

SCHEMA = "chrom string, pos int, id string, ref string, alt array<string>, qual double, filter string, info map<string,string>, samples array<map<string,string>>"
#: Fixed: struct code and count per sample of each typed FORMAT field; G stands for genotypes of the site's alleles.
BLOCKS = {"GT": ("B", 1), "GQ": ("B", 1), "DP": ("H", 1), "DV": ("H", 1), "SP": ("i", 1), "PL": ("B", "G"), "GL": ("f", "G")}


def _gt(code: int) -> str:
    sep = "|" if code >> 6 & 1 else "/"
    return f".{sep}." if code >> 7 else f"{code >> 3 & 7}{sep}{code & 7}"


def _gt_code(text: str) -> int:
    sep = "|" if "|" in text else "/"
    a, _, b = text.partition(sep)
    phased = (sep == "|") << 6
    return 1 << 7 | phased if "." in (a, b or a) else phased | int(a) << 3 | int(b or a)


def _names(raw: bytes) -> list[str]:
    return [x.decode() for x in raw.split(b"\0") if x]


def decode(stream):
    """(samples, meta text, iterator of records in SCHEMA order)."""
    if stream.read(4) != b"BCF\4":
        raise ValueError("not a binary site file")
    part = lambda: stream.read(struct.unpack("<i", stream.read(4))[0])
    chroms, samples, meta = _names(part()), _names(part()), part().split(b"\0")[0].decode()

    def each():
        while head := stream.read(16):
            seq_id, pos, qual, n = struct.unpack("<iifi", head)
            f = [x.decode() for x in stream.read(n).split(b"\0")][:6]
            ident, ref, alt, flt, info, fmt = (f + [""] * 6)[:6]
            alts = alt.split(",") if alt else []
            g = (len(alts) + 1) * (len(alts) + 2) // 2
            values: list[dict] = [{} for _ in samples]
            for key in fmt.split(":") if fmt else []:
                code, count = BLOCKS[key]
                k = g if count == "G" else count
                data = struct.unpack(f"<{len(samples) * k}{code}", stream.read(len(samples) * k * struct.calcsize(code)))
                for i in range(len(samples)):
                    own = data[i * k : (i + 1) * k]
                    values[i][key] = _gt(own[0]) if key == "GT" else ",".join(f"{x:g}" for x in own)
            pairs = dict((x.split("=", 1) if "=" in x else (x, None)) for x in info.split(";")) if info else {}
            yield (chroms[seq_id], pos, ident or ".", ref, alts or ["."], None if qual != qual else float(qual), flt or ".", pairs, values)

    return samples, meta, each()


def encode_header(chroms: list[str], samples: list[str], meta: str = "") -> bytes:
    out = [b"BCF\4"]
    for raw in (b"".join(c.encode() + b"\0" for c in chroms), b"".join(s.encode() + b"\0" for s in samples), meta.encode() + b"\0"):
        out.append(struct.pack("<i", len(raw)) + raw)
    return b"".join(out)


def encode_record(r: dict, seq_id: dict[str, int]) -> bytes:
    """A site row in the text reader's columns; FORMAT fields must be of BLOCKS."""
    alts = [a for a in r["alt"] if a != "."]
    keys = list(r["samples"][0]) if r["samples"] else []
    info = ";".join(k if v is None else f"{k}={v}" for k, v in sorted(r["info"].items()))
    dot = lambda x: "" if x in (None, ".") else x
    text = b"".join(x.encode() + b"\0" for x in (dot(r["id"]), r["ref"], ",".join(alts), dot(r["filter"]), info, ":".join(keys)))
    out = [struct.pack("<iifi", seq_id[r["chrom"]], r["pos"], float("nan") if r["qual"] is None else r["qual"], len(text)) + text]
    g = (len(alts) + 1) * (len(alts) + 2) // 2
    for key in keys:
        code, count = BLOCKS[key]
        k = g if count == "G" else count
        for s in r["samples"]:
            own = [_gt_code(s[key])] if key == "GT" else [float(x) if code == "f" else int(x) for x in s[key].split(",")]
            if len(own) != k:
                raise ValueError(f"{key} needs {k} values")
            out.append(struct.pack(f"<{k}{code}", *own))
    return b"".join(out)


def encode(rows, chroms: list[str], samples: list[str], meta: str = "") -> bytes:
    """Whole file of site rows."""
    raw = io.BytesIO()
    out = Writer(raw)
    out.write(encode_header(chroms, samples, meta))
    seq_id = {c: k for k, c in enumerate(chroms)}
    for r in rows:
        out.write(encode_record(r, seq_id))
    out.close()
    return raw.getvalue()


@contextmanager
def _opened(file: str):
    import pyarrow.fs as pafs

    fs, path = pafs.FileSystem.from_uri(file if "://" in file else "file://" + file)
    with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
        yield io.BufferedReader(stream)


def sample_names(path: str) -> list[str]:
    """Samples of the header of a file, or of the first file of a folder."""
    files = files_of(path, ".bcf")
    if not files:
        return []
    with _opened(files[0]) as stream:
        return decode(stream)[0]


class _Partition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_Partition(p) for p in self.paths]

    def read(self, partition):
        with _opened(partition.path) as stream:
            yield from decode(stream)[2]


class _Writer(FileWriter):
    """Options: ``chroms`` and ``samples``, JSON lists of names; ``meta``, the header's text."""

    ending = ".bcf"

    def head(self):
        self.seq_id = {c: k for k, c in enumerate(self.option("chroms", []))}
        return encode_header(self.option("chroms", []), self.option("samples", []), self.options.get("meta", ""))

    def record(self, row):
        return encode_record({**row, "info": dict(row["info"] or []), "samples": [dict(x) for x in row["samples"] or []]}, self.seq_id)


class BcfDataSource(DataSource):
    @classmethod
    def name(cls):
        return "bcf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(files_of(self.options["path"], ".bcf"))

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BcfDataSource)


COLUMNS = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "samples"]


def write(sites, folder: str, chroms: list[str], samples: list[str], meta: str = "") -> list[str]:
    """Write each partition of ``sites`` as one file below ``folder``; returns the files there."""
    register(sites.sparkSession)
    w = sites.select(*COLUMNS).write.format("bcf").mode("append").option("chroms", json.dumps(chroms)).option("samples", json.dumps(samples))
    w.option("meta", meta).save(folder)
    return files_of(folder, ".bcf")
