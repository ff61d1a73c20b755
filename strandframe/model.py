"""Record model: flags, CIGAR operations, schemas. Positions are 0-based half-open in memory, 1-based in text."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values of the alignment record format.
PAIRED, PROPER, UNMAP, MUNMAP, REVERSE, MREVERSE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
READ1, READ2, SECONDARY, QCFAIL, DUP, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800
#: Reads that pileup leaves out, and those that consensus leaves out (duplicates stay there).
PILEUP_SKIP = UNMAP | SECONDARY | QCFAIL | DUP
CONSENSUS_SKIP = UNMAP | SECONDARY | QCFAIL | SUPPLEMENTARY
FLAG_CHARS = "pPuUrR12sfd"
CIGAR_OPS = "MIDNSHP=XB"
QUERY_OPS = "MIS=X"
REF_OPS = "MDN=X"

CIGAR = T.ArrayType(T.StructType([T.StructField("len", T.IntegerType()), T.StructField("op", T.StringType())]))
TAGS = T.MapType(T.StringType(), T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]))
READ = T.StructType(
    [
        T.StructField("qname", T.StringType()), T.StructField("flag", T.IntegerType()), T.StructField("rname", T.StringType()),
        T.StructField("pos", T.IntegerType()), T.StructField("mapq", T.IntegerType()), T.StructField("cigar", CIGAR),
        T.StructField("rnext", T.StringType()), T.StructField("pnext", T.IntegerType()), T.StructField("tlen", T.IntegerType()),
        T.StructField("seq", T.StringType()), T.StructField("qual", T.StringType()), T.StructField("tags", TAGS),
    ]
)
