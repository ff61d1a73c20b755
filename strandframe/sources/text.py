"""Readers and writers of text formats: FASTA, aligned reads, BED, VCF.

Readers work line by line on splittable text where the format allows it. ``ord`` is the order of arrival: it is
taken at the scan, before any shuffle, from the file's place and the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reads import flag_string, format_cigar, parse_cigar, parse_flag, query_length
from ..model import TAGS  # noqa: F401


def read_fasta(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(name, description, seq): one row a record. The record separator is the header mark, so large files split.

    ``strict`` takes only ACGTN, upper-cased, and raises on anything else."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", r"^(?:\s*>)+", "")
    rows = raw.select(F.split(text, "\n", 2).alias("p")).where(F.length(F.trim(F.col("p")[0])) > 0)
    head, body = F.col("p")[0], F.coalesce(F.try_element_at("p", F.lit(2)), F.lit(""))
    seq = F.regexp_replace(body, r"[\s]+", "")
    if strict:
        seq = F.upper(seq)
        seq = F.when(seq.rlike("^[ACGTN]*$"), seq).otherwise(F.raise_error(F.concat(F.lit("not a sequence of ACGTN: "), head)))
    return rows.select(F.regexp_extract(head, r"^\s*(\S+)", 1).alias("name"), F.trim(F.regexp_extract(head, r"^\s*\S+\s*(.*)$", 1)).alias("description"), seq.alias("seq"))


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """(ref_aln, seq_aln) of the first two records of a FASTA file over ACGTN-; fewer than two raise an error."""
    raw = spark.read.text(path, wholetext=True)
    parts = F.filter(F.split("value", "(?m)^>"), lambda x: F.length(F.trim(x)) > 0)
    body = lambda k: F.upper(F.regexp_replace(F.regexp_replace(F.element_at(parts, k), r"^[^\n]*\n", ""), r"\s", ""))
    ok = lambda s: F.when(s.rlike("^[ACGTN-]*$"), s).otherwise(F.raise_error(F.lit("an alignment may hold A, C, G, T, N and - only")))
    rows = raw.select(F.when(F.size(parts) >= 2, F.lit(True)).otherwise(F.raise_error(F.lit("an alignment needs two records"))).alias("_ok"), ok(body(1)).alias("ref_aln"), ok(body(2)).alias("seq_aln"))
    same = F.when(F.length("ref_aln") == F.length("seq_aln"), F.col("ref_aln")).otherwise(F.raise_error(F.lit("rows of an alignment differ in length")))
    return rows.where("_ok").select(same.alias("ref_aln"), "seq_aln")


def format_fasta(df: DataFrame, name: str = "name", seq: str = "seq", width: int = 60) -> DataFrame:
    """(value): FASTA text of each row, wrapped at ``width`` columns."""
    wrapped = F.regexp_replace(F.regexp_replace(F.col(seq), f"(.{{{width}}})", "$1\n"), "\n$", "")
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrapped).alias("value"))


def plain_column(seq) -> Column:
    """Lower-case sequence without gaps."""
    return F.lower(F.replace(F.col(seq) if isinstance(seq, str) else seq, F.lit("-"), F.lit("")))


def plain_sequence(df: DataFrame, seq: str = "seq") -> DataFrame:
    """(value): lower-case sequence without gaps."""
    return df.select(plain_column(seq).alias("value"))


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, type, tags) of header lines."""
    h = spark.read.text(path).where(F.col("value").startswith("@")).withColumn("line_no", F.monotonically_increasing_id())
    parts = F.split("value", "\t")
    pairs = F.transform(F.filter(F.slice(parts, 2, 1000), lambda x: F.instr(x, ":") == 3), lambda x: F.struct(F.left(x, F.lit(2)).alias("k"), F.substring(x, 4, 1 << 30).alias("v")))
    return h.select("line_no", F.substring(parts[0], 2, 10).alias("type"), F.map_from_entries(pairs).alias("tags"))


def read_sam(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Aligned reads of the text format: eleven columns and tags, position 0-based, ``ord`` in order of arrival."""
    rows = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    c = F.split("value", "\t")
    tags = F.map_from_entries(
        F.transform(F.slice(c, 12, 10_000), lambda t: F.struct(F.left(t, F.lit(2)).alias("k"), F.struct(F.substring(t, 4, 1).alias("type"), F.substring(t, 6, 1 << 30).alias("value")).alias("v")))
    )
    out = rows.where(F.when(F.size(c) >= 11, True).otherwise(F.raise_error(F.concat(F.lit("too few columns: "), F.col("value"))))).select(
        F.get(c, F.lit(0)).alias("qname"), parse_flag(F.get(c, F.lit(1))).alias("flag"), F.get(c, F.lit(2)).alias("rname"), (F.get(c, F.lit(3)).cast("int") - 1).alias("pos"), F.get(c, F.lit(4)).cast("int").alias("mapq"),
        parse_cigar(F.get(c, F.lit(5))).alias("cigar"), F.when(F.get(c, F.lit(6)) == "=", F.get(c, F.lit(2))).otherwise(F.get(c, F.lit(6))).alias("rnext"), (F.get(c, F.lit(7)).cast("int") - 1).alias("pnext"), F.get(c, F.lit(8)).cast("int").alias("tlen"),
        F.when(F.get(c, F.lit(9)) != "*", F.get(c, F.lit(9))).alias("seq"), F.when(F.get(c, F.lit(10)) != "*", F.get(c, F.lit(10))).alias("qual"), tags.alias("tags"), "ord",
    )
    if check:
        bad = F.col("seq").isNotNull() & (F.size("cigar") > 0) & (query_length("cigar") != F.length("seq"))
        out = out.where(F.when(bad, F.raise_error(F.concat(F.lit("CIGAR and sequence differ in length: "), F.col("qname")))).otherwise(True))
    return out


def format_sam(reads: DataFrame, flags: str = "dec") -> DataFrame:
    """(value): text lines; flags as dec, hex or char."""
    shown = {"dec": F.col("flag").cast("string"), "hex": F.concat(F.lit("0x"), F.lower(F.hex("flag"))), "char": flag_string("flag")}[flags]
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.concat_ws(":", t["key"], t["value"]["type"], t["value"]["value"]))
    next_name = F.when((F.col("rnext") == F.col("rname")) & (F.col("rnext") != "*"), "=").otherwise(F.col("rnext"))
    star = lambda x: F.coalesce(F.col(x), F.lit("*"))
    return reads.select(
        F.concat_ws("\t", "qname", shown, "rname", F.col("pos") + 1, "mapq", format_cigar("cigar"), next_name, F.col("pnext") + 1, "tlen", star("seq"), star("qual"), F.when(F.size("tags") > 0, F.array_join(tags, "\t"))).alias("value")
    )


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, beg, end); a line of two columns is the 1-based position; comments and blank lines are left out."""
    c = F.split("value", r"\s+")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)"))
    two = F.size(c) < 3
    return rows.select(F.get(c, F.lit(0)).alias("chrom"), F.when(two, F.get(c, F.lit(1)).cast("int") - 1).otherwise(F.get(c, F.lit(1)).cast("int")).alias("beg"), F.when(two, F.get(c, F.lit(1)).cast("int")).otherwise(F.try_element_at(c, F.lit(3)).cast("int")).alias("end"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, id, ref, alt, qual, filter, info, samples): pos 0-based, info a map, samples an array of maps by FORMAT key."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0))
    c = F.split("value", "\t")
    keys = F.split(F.try_element_at(c, F.lit(9)), ":")
    info = F.when(F.get(c, F.lit(7)) == ".", F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(F.transform(F.split(F.get(c, F.lit(7)), ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.instr(x, "=") > 0, F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("v")))))
    samples = F.transform(F.slice(c, 10, 1 << 20), lambda s: F.map_from_arrays(F.slice(keys, F.lit(1), F.least(F.size(keys), F.size(F.split(s, ":")))), F.slice(F.split(s, ":"), F.lit(1), F.least(F.size(keys), F.size(F.split(s, ":"))))))
    return lines.select(
        F.get(c, F.lit(0)).alias("chrom"), (F.get(c, F.lit(1)).cast("int") - 1).alias("pos"), F.get(c, F.lit(2)).alias("id"), F.get(c, F.lit(3)).alias("ref"), F.split(F.get(c, F.lit(4)), ",").alias("alt"), F.get(c, F.lit(5)).try_cast("double").alias("qual"), F.get(c, F.lit(6)).alias("filter"), info.alias("info"),
        F.when(F.size(c) > 9, samples).otherwise(F.array().cast("array<map<string,string>>")).alias("samples"),
    )


def format_vcf(sites: DataFrame) -> DataFrame:
    """(value): site lines; FORMAT keys are those of the first sample, in order."""
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    keys = F.map_keys(F.try_element_at("samples", F.lit(1)))
    fmt = F.array_join(keys, ":")
    values = F.array_join(F.transform("samples", lambda s: F.array_join(F.transform(keys, lambda k: F.coalesce(F.try_element_at(s, k), F.lit("."))), ":")), "\t")
    tail = F.when(F.size("samples") > 0, F.concat_ws("\t", fmt, values))
    q = F.when(F.col("qual").isNull(), ".").otherwise(F.regexp_replace(F.format_string("%.6f", "qual"), r"\.?0+$", ""))
    return sites.select(F.concat_ws("\t", "chrom", F.col("pos") + 1, "id", "ref", F.array_join("alt", ","), q, "filter", F.when(info == "", ".").otherwise(info), tail).alias("value"))


def to_fastq(reads: DataFrame, suffix: bool = True) -> DataFrame:
    """(value): FASTQ records; reverse-strand reads are turned back; /1 and /2 by read number unless ``suffix`` is false."""
    from ..functions.reads import any_of, reverse_complement

    rev = any_of("flag", 16)
    mark = F.when(any_of("flag", 64), "/1").when(any_of("flag", 128), "/2").otherwise("") if suffix else F.lit("")
    qual = F.coalesce("qual", F.repeat(F.lit("B"), F.length("seq")))
    return reads.where("seq is not null").select(
        F.concat_ws("\n", F.concat(F.lit("@"), "qname", mark), F.when(rev, reverse_complement("seq")).otherwise(F.col("seq")), F.lit("+"), F.when(rev, F.reverse(qual)).otherwise(qual)).alias("value")
    )


def to_bed(reads: DataFrame) -> DataFrame:
    """(chrom, beg, end, name, score, strand): spans of M, D and N."""
    from ..functions.reads import any_of, none_of, span

    r = reads.where(none_of("flag", 4) & (F.col("pos") >= 0))
    return r.select(F.col("rname").alias("chrom"), F.col("pos").alias("beg"), (F.col("pos") + span("cigar", "MDN")).alias("end"), F.col("qname").alias("name"), F.col("mapq").alias("score"), F.when(any_of("flag", 16), "-").otherwise("+").alias("strand"))
