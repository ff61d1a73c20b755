"""Per-read column expressions: flags, CIGAR, bins, strings, hashes, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import FLAG_CHARS, QUERY_OPS, REF_OPS

BASES = "ACGTacgt"
IUPAC, IUPAC_COMPLEMENT = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has(flag, bits: int) -> Column:
    """All of ``bits`` are set."""
    return c(flag).bitwiseAND(bits) == bits


def any_of(flag, bits: int) -> Column:
    return c(flag).bitwiseAND(bits) != 0


def none_of(flag, bits: int) -> Column:
    return c(flag).bitwiseAND(bits) == 0


def parse_cigar(text) -> Column:
    """``8M4I`` to [(8, M), (4, I)]; ``*`` to an empty array."""
    t = c(text)
    ops = F.regexp_extract_all(t, F.lit(r"(\d+[MIDNSHP=XB])"), F.lit(1))
    out = F.transform(ops, lambda x: F.struct(F.regexp_extract(x, r"(\d+)", 1).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))
    whole = F.regexp_replace(t, r"\d+[MIDNSHP=XB]", "")
    return F.when(t.isNull(), None).when(t == "*", F.array().cast("array<struct<len:int,op:string>>")).when(whole == "", out).otherwise(F.raise_error(F.concat(F.lit("bad CIGAR: "), t)))


def format_cigar(cigar) -> Column:
    text = F.array_join(F.transform(c(cigar), lambda x: F.concat(x["len"].cast("string"), x["op"])), "")
    return F.when(F.size(c(cigar)) > 0, text).otherwise("*")


def span(cigar, ops: str) -> Column:
    """Summed length of the operations in ``ops``."""
    return F.aggregate(c(cigar), F.lit(0), lambda a, x: a + F.when(F.lit(ops).contains(x["op"]), x["len"]).otherwise(0))


def query_length(cigar) -> Column:
    return span(cigar, QUERY_OPS)


def reference_end(pos, cigar) -> Column:
    """End of an alignment; an op B steps back; without a CIGAR the read has length 1."""
    moved = F.aggregate(
        c(cigar),
        F.struct(c(pos).cast("int").alias("at"), c(pos).cast("int").alias("end")),
        lambda a, x: F.struct(
            (a["at"] + F.when(F.lit(REF_OPS).contains(x["op"]), x["len"]).when(x["op"] == "B", -x["len"]).otherwise(0)).alias("at"),
            F.greatest(a["end"], a["at"] + F.when(F.lit(REF_OPS).contains(x["op"]), x["len"]).otherwise(0)).alias("end"),
        ),
    )["end"]
    return F.when(F.size(c(cigar)) > 0, moved).otherwise(c(pos) + 1)


def aligned_blocks(pos, cigar, ops: str = "M=X") -> Column:
    """[(rbeg, rend, qbeg, op, len)] of the operations in ``ops``."""
    init = F.struct(c(pos).cast("int").alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<rbeg:int,rend:int,qbeg:int,op:string,len:int>>").alias("out"))

    def step(a, x):
        r = F.when(F.lit(REF_OPS).contains(x["op"]), x["len"]).otherwise(0)
        q = F.when(F.lit(QUERY_OPS).contains(x["op"]), x["len"]).otherwise(0)
        own = F.array(F.struct(a["r"].alias("rbeg"), (a["r"] + r).alias("rend"), a["q"].alias("qbeg"), x["op"].alias("op"), x["len"].alias("len")))
        return F.struct((a["r"] + r).alias("r"), (a["q"] + q).alias("q"), F.when(F.lit(ops).contains(x["op"]), F.concat(a["out"], own)).otherwise(a["out"]).alias("out"))

    return F.aggregate(c(cigar), init, step)["out"]


def bin_of(beg, end) -> Column:
    """Smallest bin of the six-level scheme that holds [beg, end)."""
    b, e = c(beg), c(end) - 1
    out = F.lit(0)
    for shift in (26, 23, 20, 17, 14):
        first = ((1 << (29 - shift)) - 1) // 7
        out = F.when(F.shiftright(b, shift) == F.shiftright(e, shift), first + F.shiftright(b, shift)).otherwise(out)
    return out.cast("int")


def bins_over(beg, end) -> Column:
    """All bins that may hold records overlapping [beg, end)."""
    b, e = c(beg), c(end) - 1
    parts = [F.array(F.lit(0))]
    for shift in (26, 23, 20, 17, 14):
        first = ((1 << (29 - shift)) - 1) // 7
        parts.append(F.sequence(first + F.shiftright(b, shift), first + F.shiftright(e, shift)))
    return F.concat(*parts)


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(c(seq), IUPAC, IUPAC_COMPLEMENT))


def flag_string(flag) -> Column:
    """Set bits as the characters of FLAG_CHARS."""
    return F.concat(*[F.when(c(flag).bitwiseAND(1 << k) != 0, F.lit(x)).otherwise("") for k, x in enumerate(FLAG_CHARS)])


def parse_flag(text) -> Column:
    """Decimal, 0x hex, or characters of FLAG_CHARS."""
    t = c(text)
    chars = sum((F.when(F.instr(t, x) > 0, F.lit(1 << k)).otherwise(0) for k, x in enumerate(FLAG_CHARS)), F.lit(0))
    hexed = F.conv(F.substring(t, 3, 16), 16, 10).cast("int")
    return F.when(t.rlike("^0[xX][0-9a-fA-F]+$"), hexed).when(t.rlike(r"^\d+$"), t.try_cast("int")).otherwise(chars)


def x31(text) -> Column:
    """h = h*31 + byte in 32 bits, over the bytes of an ASCII name."""
    n = F.length(c(text))
    step = lambda h, i: F.pmod(h * 31 + F.ascii(F.substring(c(text), i, F.lit(1))), F.lit(1 << 32))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("long"), step)).otherwise(F.lit(0).cast("long"))


def wang(number) -> Column:
    """Integer mix of 32 bits by shifts, sums and exclusive ors."""
    low = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))
    x = low(c(number).cast("long"))
    for shift, kind in ((15, "sum of complement"), (10, "xor"), (3, "sum"), (6, "xor"), (11, "sum of complement"), (16, "xor")):
        if kind == "xor":
            x = x.bitwiseXOR(F.shiftright(x, shift))
        else:
            moved = low(F.shiftleft(x, shift))
            x = low(x + (low(F.bitwise_not(moved)) if kind == "sum of complement" else moved))
    return x


def parse_region(text) -> Column:
    """``chr[:beg[-end]]`` to (chrom, beg, end): 0-based half-open; commas and spaces ignored; the last colon splits."""
    t = F.regexp_replace(c(text), "[, ]", "")
    m = r"^(.*):(\d+)(?:-(\d+))?$"
    has_range = t.rlike(m)
    end = F.regexp_extract(t, m, 3)
    return F.struct(
        F.when(has_range, F.regexp_extract(t, m, 1)).otherwise(t).alias("chrom"),
        F.when(has_range, F.greatest(F.regexp_extract(t, m, 2).try_cast("int") - 1, F.lit(0))).otherwise(0).alias("beg"),
        F.when(has_range & (end != ""), end.try_cast("int")).otherwise(1 << 29).alias("end"),
    )


def tag(tags, name: str) -> Column:
    return F.try_element_at(c(tags), F.lit(name))["value"]


def set_tag(tags, name: str, kind: str, value) -> Column:
    own = F.create_map(F.lit(name), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value")))
    return F.map_concat(F.map_filter(c(tags), lambda k, _: k != name), own)


def drop_tag(tags, *names: str) -> Column:
    return F.map_filter(c(tags), lambda k, _: ~k.isin(*names))


def keep_tags(tags, *names: str) -> Column:
    return F.map_filter(c(tags), lambda k, _: k.isin(*names))


def scale_quality(qual, factor: float) -> Column:
    """min(q * factor, 93), whole numbers."""
    return F.transform(c(qual), lambda q: F.least((q * factor).cast("int"), F.lit(93)))


def trim_length(qual, threshold: int, min_length: int = 35) -> Column:
    """Bases cut from the 3' end: the length at which the running sum of threshold - q peaks (none once it turns negative)."""
    n = F.size(c(qual))
    state = F.struct(F.lit(0).alias("s"), F.lit(0).alias("best"), F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit(True).alias("on"))

    def step(a, q):
        s, i = a["s"] + threshold - q, a["i"] + 1
        on = a["on"] & (s >= 0) & (i < n - min_length + 1)
        top = on & (s > a["best"])
        return F.struct(F.when(on, s).otherwise(a["s"]).alias("s"), F.when(top, s).otherwise(a["best"]).alias("best"), F.when(top, i).otherwise(a["at"]).alias("at"), i.alias("i"), on.alias("on"))

    return F.when(n > min_length, F.aggregate(F.reverse(c(qual)), state, step)["at"]).otherwise(0)


def pair_orientation(flag, pos, pnext) -> Column:
    """inward, outward or other, from both strands and the order of the mates."""
    own, mate = any_of(flag, 0x10), any_of(flag, 0x20)
    left_forward = F.when(c(pos) <= c(pnext), ~own & mate).otherwise(own & ~mate)
    return F.when(own == mate, "other").when(left_forward, "inward").otherwise("outward")


def aligned_and_inserted(cigar) -> Column:
    """Summed length of M and I."""
    return span(cigar, "MI")


def natural_key(name) -> Column:
    """Sort key for names: digit runs by value, equal values with more leading zeros first, else by character."""
    tokens = F.regexp_extract_all(c(name), F.lit(r"(\d+|\D)"), F.lit(1))

    def one(x):
        digits = x.rlike(r"^\d+$")
        value = F.regexp_replace(x, "^0+(?=.)", "")
        return F.struct(
            F.when(digits, F.lit(48)).otherwise(F.ascii(x)).alias("c"),
            F.when(digits, F.length(value)).otherwise(0).alias("n"),
            F.when(digits, value).otherwise("").alias("v"),
            F.when(digits, F.length(value) - F.length(x)).otherwise(0).alias("z"),
        )

    return F.transform(tokens, one)


#: Fixed: 2^63 - 1 and 2^64, as decimals of SQL.
_HALF, _WHOLE = "9223372036854775807BD", "18446744073709551616BD"


def packed_rank(score, order) -> Column:
    """One number that is greater for a higher integer ``score`` and, on ties, an earlier ``order``. Its maximum is a buffer of fixed width, which
    a hash aggregate holds, unlike a struct's."""
    return (c(score).cast("decimal(10,0)") * F.expr(_WHOLE) + (F.expr(_HALF) - c(order).cast("decimal(20,0)"))).cast("decimal(30,0)")


def order_of(rank) -> Column:
    """``order`` of a packed rank."""
    return (F.expr(_HALF) - F.pmod(c(rank).cast("decimal(38,0)"), F.expr(_WHOLE))).cast("long")
