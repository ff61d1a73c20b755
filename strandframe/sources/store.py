"""One door to the formats, and the sorted layout that stands for an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reads import bin_of
from ..operators.records import concatenate
from . import binary, sites_binary, text


def open_reads(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """Reads of a text (sam), binary (bam) or Parquet path; the kind follows the ending unless given. ``options`` go to the binary source."""
    kind = kind or path.rstrip("/").rpartition(".")[2]
    if kind == "bam":
        binary.register(spark)
        return spark.read.format("bam").options(**options).load(path)
    return text.read_sam(spark, path) if kind == "sam" else spark.read.parquet(path)


def open_sites(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Sites of a text (vcf), binary (bcf) or Parquet path."""
    kind = kind or path.rstrip("/").rpartition(".")[2]
    if kind == "bcf":
        sites_binary.register(spark)
        return spark.read.format("bcf").load(path)
    return text.read_vcf(spark, path) if kind == "vcf" else spark.read.parquet(path)


def sample_names(spark: SparkSession, path: str, kind: str | None = None) -> list[str]:
    """Names of the samples in the header of a site file, or of the first file of a folder; none without a header."""
    kind = kind or path.rstrip("/").rpartition(".")[2]
    if kind == "bcf":
        return sites_binary.sample_names(path)
    line = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    return line[0].split("\t")[9:] if line else []


def concatenate_sites(spark: SparkSession, paths: list[str], kind: str | None = None) -> DataFrame:
    """Sites of several files one after the other, unsorted, with ``file`` (place in ``paths``). All must name the same samples in the
    same order, as a row holds its samples by place."""
    if not paths:
        raise ValueError("no files")
    names = [sample_names(spark, p, kind) for p in paths]
    for path, own in zip(paths, names, strict=True):
        if own != names[0]:
            raise ValueError(f"other samples in {path}: {own}, not {names[0]}")
    out = [open_sites(spark, p, kind).withColumn("file", F.lit(k)) for k, p in enumerate(paths)]
    return concatenate(out)


def write_indexed(reads: DataFrame, path: str, partitions: int = 0, contig: str = "rname", pos: str = "pos", end: str = "_end") -> None:
    """Parquet in coordinate order: range-partitioned and sorted, so footers' minima and maxima prune region reads. Adds ``bin``."""
    r = reads.withColumn("bin", bin_of(F.greatest(pos, F.lit(0)), F.greatest(F.col(end) if end in reads.columns else F.col(pos) + 1, F.col(pos) + 1, F.lit(1))))
    n = partitions or int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r.repartitionByRange(n, contig, pos).sortWithinPartitions(contig, pos).write.mode("overwrite").parquet(path)


def write_text(lines: DataFrame, path: str, header: DataFrame | None = None) -> None:
    """Write (value) lines; a header (value) comes first, in a part of its own."""
    out = lines.select("value")
    if header is not None:
        out = header.select("value").coalesce(1).unionByName(out)
    out.write.mode("overwrite").text(path)
