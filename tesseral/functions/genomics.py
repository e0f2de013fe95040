"""Scalar functions of the variant domain as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesseral.functions import logprob as lp

#: IUPAC ambiguity codes.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT",
    "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
#: Fixed value: share of a miscall that falls on each other base.
MISCALL_SHARE = 0.3333
#: SAM flag bits.
PAIRED, UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x1, 0x4, 0x10, 0x20, 0x40, 0x100, 0x200, 0x400, 0x800
#: Flags of reads that a methylation candidate accepts.
METHYLATION_FLAGS = (0, 16, 83, 99, 147, 163)


def read_base_ln(read: Column, allele: Column, qual: Column) -> Column:
    """Log probability to read a base if the allele is ``allele``, given its base quality; an N that doesn't match is neutral."""
    miscall = lp.phred_to_ln(qual)
    return F.when(F.upper(read) == F.upper(allele), lp.one_minus(miscall)).when(F.upper(read) == "N", F.lit(math.log(0.25))).otherwise(miscall + math.log(MISCALL_SHARE))


def log2_fold_change(a: Column, b: Column) -> Column:
    """log2 of a over b: 0 for two zeros, infinity over zero, minus infinity of zero."""
    return F.when((a == 0) & (b == 0), F.lit(0.0)).when(b == 0, F.lit(float("inf"))).when(a == 0, F.lit(float("-inf"))).otherwise(F.log2(a) - F.log2(b))


def fold_bounds(op: str, value: float, vaf: Column) -> Column:
    """Frequencies of b that ``l2fc(a, b) op value`` leaves for a given frequency of a, within 0 and 1: (lo, hi, lo_open, hi_open).

    Null where no frequency is left.  A frequency of a of zero fixes the change to minus
    infinity (or 0 where b is zero too), so that the bounds then only say where b may be.
    """
    at = vaf / F.lit(2.0**value)
    struct = lambda lo, hi, lo_open, hi_open: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), F.lit(lo_open).alias("lo_open"), F.lit(hi_open).alias("hi_open"))
    zero, one = F.lit(0.0), F.lit(1.0)
    if op == "==":
        return F.when(at <= 1, struct(at, at, False, False))
    if op in (">", ">="):
        return F.when(at > 1, struct(zero, one, False, False)).otherwise(struct(zero, at, False, op == ">"))
    if op in ("<", "<="):
        return F.when((at < 1) | ((at == 1) & F.lit(op == "<=")), struct(at, one, op == "<", False))
    return struct(zero, one, False, False)


def flipped_fold(op: str, value: float) -> tuple[str, float]:
    """The same condition on l2fc(b, a)."""
    return FLIPPED[op], 0.0 - value


def fold_holds(change: Column, op: str, value: float) -> Column:
    """Whether a fold change meets a condition; equality up to rounding."""
    if op in ("==", "!="):
        near = F.abs(change - value) <= 1e-12 * max(1.0, abs(value))
        return near if op == "==" else ~near
    return COMPARE[op](change, F.lit(value))


COMPARE = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}
NEGATED = {"==": "!=", "!=": "==", ">": "<=", ">=": "<", "<": ">=", "<=": ">"}
FLIPPED = {"==": "==", "!=": "!=", ">": "<", ">=": "<=", "<": ">", "<=": ">="}


def compare(a: Column, op: str, b: Column) -> Column:
    """A comparison by its operator's sign."""
    return COMPARE[op](a, b)


def complement(base: Column) -> Column:
    """Complement of the bases of a string; N stays."""
    return F.translate(F.upper(base), "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    """Reverse complement of a sequence."""
    return F.reverse(complement(seq))


def substitution_signature(ref: Column, alt: Column) -> Column:
    """Signature of a single-base change on the pyrimidine strand (C>A ... T>G); null for anything else."""
    r, a = F.upper(ref), F.upper(alt)
    valid = r.rlike("^[ACGT]$") & a.rlike("^[ACGT]$") & (r != a)
    flip = r.isin("A", "G")
    return F.when(valid, F.concat(F.when(flip, complement(r)).otherwise(r), F.lit(">"), F.when(flip, complement(a)).otherwise(a)))


def change_class(ref: Column, alt: Column) -> Column:
    """Signature or variant class of a record by its alleles alone; null for single bases that are no substitution."""
    rl, al = F.length(ref), F.length(alt)
    named = F.regexp_extract(alt, "^<(DEL|INV|DUP|BND|METH)>$", 1)
    return (
        F.when(named != "", named)
        .when((rl == 1) & (al == 1), substitution_signature(ref, alt))
        .when((rl > 1) & (al == 1), F.lit("DEL"))
        .when((rl == 1) & (al > 1), F.lit("INS"))
        .when((rl == al) & (rl > 1), F.lit("MNV"))
        .otherwise(F.lit("Complex"))
    )


def genotype(af: Column, depth: Column) -> Column:
    """Diploid genotype of an allele frequency estimate."""
    return F.when(af == 0.0, "0/0").when(af == 0.5, "0/1").when(af == 1.0, "1/1").when(af.isNotNull() & (depth > 0), "0/1").otherwise("./.")


def locus_bucket(pos: Column, max_read_len: int) -> Column:
    """Start of the bucket of ten read lengths that a position is in."""
    width = 10 * int(max_read_len)
    return F.floor(pos / F.lit(width)) * width


def has_flag(flag: Column, bit: int) -> Column:
    """Whether a SAM flag has a bit set."""
    return flag.bitwiseAND(F.lit(bit)) != 0


def valid_read(flag: Column) -> Column:
    """Neither secondary, duplicate, unmapped nor of failed quality."""
    return flag.bitwiseAND(F.lit(SECONDARY | DUPLICATE | UNMAPPED | QC_FAIL)) == 0


def strand_of_flag(flag: Column) -> Column:
    """Forward or Reverse by the flag's bit."""
    return F.when(has_flag(flag, REVERSE), "Reverse").otherwise("Forward")


def strand_of_symbol(s: Column) -> Column:
    """Strand of its symbol: + - * and . for forward, reverse, both and none; anything else is an error, null stays null."""
    return F.when(s == "+", "Forward").when(s == "-", "Reverse").when(s == "*", "Both").when(s == ".", "None").when(s.isNotNull(), F.raise_error(F.concat(F.lit("no strand: "), s)).cast("string"))


def strand_at(flag: Column, symbols: Column, place: Column) -> Column:
    """Strand of a read at a place (from 0): by its string of symbols per base where it has one, else by its flag."""
    return F.coalesce(strand_of_symbol(F.substr(symbols, (place + 1).cast("int"), F.lit(1))), strand_of_flag(flag))


def entire_fragment(tag: Column) -> Column:
    """Whether a read spans its entire fragment: its whole-number tag is 1."""
    return F.coalesce(tag == 1, F.lit(False))


def merge_strands(a: Column, b: Column) -> Column:
    """Union of two strands."""
    return F.when(a == "None", b).when(b == "None", a).when(a == b, a).otherwise(F.lit("Both"))


def read_orientation(first_pos: Column, first_reverse: Column, second_pos: Column, second_reverse: Column, same_contig: Column) -> Column:
    """Orientation of a pair in the order of positions: F1R2, F2R1, R1F2, ...; None where the mates are discordant in contig or position."""
    left_first = first_pos < second_pos
    a = F.concat(F.when(first_reverse, "R").otherwise("F"), F.lit("1"))
    b = F.concat(F.when(second_reverse, "R").otherwise("F"), F.lit("2"))
    return F.when(~same_contig | (first_pos == second_pos), "None").when(left_first, F.concat(a, b)).otherwise(F.concat(b, a))


def evidence_orientation(left: Column, right: Column) -> Column:
    """Orientation of a pair from its mates' tags: None where they differ; a read alone has its own."""
    return F.when(right.isNull(), F.coalesce(left, F.lit("None"))).when(left.eqNullSafe(right), left).otherwise(F.lit("None"))


def standard_orientation(orientation: Column) -> Column:
    """Orientations that proper pairs have, or none known."""
    return orientation.isin("F1R2", "F2R1", "None")


#: CIGAR operations as an array of structs (op, len).
def cigar_ops(cigar: Column) -> Column:
    """CIGAR text as array<struct<op string, len int>>; ``*`` gives an empty array."""
    hits = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHPX=])"), F.lit(1))
    return F.transform(hits, lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("len")))


def cigar_reference_length(ops: Column) -> Column:
    """Bases of the reference that an alignment covers."""
    return F.aggregate(ops, F.lit(0), lambda acc, x: acc + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(0))


def softclip_length(ops: Column) -> Column:
    """Longest soft clip at either end."""
    return F.aggregate(ops, F.lit(0), lambda acc, x: F.when((x["op"] == "S") & (x["len"] > acc), x["len"]).otherwise(acc))


def longest_operation(ops: Column, op: str) -> Column:
    """Longest operation of a kind, null if there is none."""
    return F.array_max(F.transform(F.filter(ops, lambda x: x["op"] == op), lambda x: x["len"]))


def has_indel(ops: Column) -> Column:
    """Whether an alignment has an insertion or deletion."""
    return F.exists(ops, lambda x: x["op"].isin("I", "D"))


def alternative_loci(xa: Column) -> Column:
    """Alternative hits of an XA tag ``chr,+pos,CIGAR,NM;...`` as array of (contig, pos, reverse, cigar, edits)."""
    hits = F.filter(F.split(xa, ";"), lambda x: x != "")
    return F.transform(
        hits,
        lambda x: F.struct(
            F.split(x, ",")[0].alias("contig"),
            F.abs(F.split(x, ",")[1].cast("long")).alias("pos"),
            F.split(x, ",")[1].startswith("-").alias("reverse"),
            F.split(x, ",")[2].alias("cigar"),
            F.split(x, ",")[3].cast("int").alias("edits"),
        ),
    )


def estimated_insert_size(left_start: Column, left_clip: Column, right_end: Column, right_clip: Column) -> Column:
    """Insert size of a pair with the clipped ends counted in."""
    return (right_end + right_clip) - (left_start - left_clip)


def sampling_ln(read_len: Column, feasible: Column, variant_len: Column) -> Column:
    """Log chance to sample the alternative allele by a read: its feasible placements over all.

    Placements are at most the read's length and that of the variant, where it has one (null:
    none).  Without a number of feasible bases (null) the chance is one.
    """
    n = F.least(read_len, variant_len)
    return F.when(feasible.isNull(), F.lit(0.0)).otherwise(lp.ln(F.least(n, feasible).cast("double")) - lp.ln(n.cast("double")))


def either_ln(p: Column, q: Column) -> Column:
    """Log chance that at least one of two independent events happens, from their log chances."""
    return lp.one_minus(lp.one_minus(p) + lp.one_minus(q))


def explained_by_errors(n_subs: Column, n_ins: Column, n_del: Column, length: Column, ln_sub: Column, ln_ins: Column, ln_del: Column) -> Column:
    """Whether edits are no more than the error rates make expect for an alignment."""
    return (n_subs <= length * F.exp(ln_sub)) & (n_ins <= length * F.exp(ln_ins)) & (n_del <= length * F.exp(ln_del))


def converted_read_ln(read: Column, qual: Column, reverse: Column) -> tuple[Column, Column]:
    """Log probabilities (methylated, not) of a base of a converted read: C against T, on the reverse strand G against A."""
    return (read_base_ln(read, F.when(reverse, "G").otherwise("C"), qual), read_base_ln(read, F.when(reverse, "A").otherwise("T"), qual))


def mutated(read: Column, reverse: Column, annotated: bool) -> Column:
    """Whether a base at a methylation site can't come from it, converted or annotated."""
    base = F.upper(read)
    forward, back = (("G", "A", "T"), ("C", "A", "T")) if annotated else (("A", "G"), ("C", "T"))
    return F.when(reverse, base.isin(*back)).otherwise(base.isin(*forward))


def from_reverse_strand(flag: Column) -> Column:
    """Whether a read shows the reverse strand: reversed, or the second of a pair that isn't."""
    reverse, first = has_flag(flag, REVERSE), has_flag(flag, FIRST)
    return F.when(has_flag(flag, PAIRED), reverse == first).otherwise(reverse)


def is_phred_description(text: Column) -> Column:
    """Whether a header's description says that its values are PHRED scaled; without any scale in brackets they are."""
    return F.coalesce(text.endswith("(PHRED)") | ~text.endswith(")"), F.lit(True))


def parse_breakend(alt: Column) -> Column:
    """Parts of a breakend ALT: bases, mate contig and position, whether the bases come first and whether the mate extends left; null fields otherwise."""
    shape = r"^([ACGTNacgtn.]*)([\[\]])([^\[\]]+):(\d+)([\[\]])([ACGTNacgtn.]*)$"
    ok = alt.rlike(shape) & (F.regexp_extract(alt, shape, 2) == F.regexp_extract(alt, shape, 5))
    before, after = F.regexp_extract(alt, shape, 1), F.regexp_extract(alt, shape, 6)
    part = lambda c: F.when(ok, c)
    return F.struct(
        part(F.when(before != "", before).otherwise(after)).alias("bases"),
        part(F.regexp_extract(alt, shape, 3)).alias("mate_contig"),
        part(F.try_to_number(F.regexp_extract(alt, shape, 4), F.lit("9999999999999999")).cast("long")).alias("mate_pos"),
        part(before != "").alias("bases_first"),
        part(F.regexp_extract(alt, shape, 2) == "]").alias("mate_left"),
    )


def format_breakend(bases: Column, mate_contig: Column, mate_pos: Column, bases_first: Column, mate_left: Column) -> Column:
    """ALT text of a breakend: the inverse of ``parse_breakend``."""
    bracket = F.when(mate_left, "]").otherwise("[")
    mate = F.concat(bracket, mate_contig, F.lit(":"), mate_pos.cast("string"), bracket)
    return F.when(bases_first, F.concat(bases, mate)).otherwise(F.concat(mate, bases))


def haplotype_id(event: Column, record_id: Column, mate_id: Column) -> Column:
    """Identifier of the haplotype a record belongs to: its event, else its id and mate in order."""
    return F.coalesce(event, F.when(record_id.isNotNull() & mate_id.isNotNull(), F.array_join(F.array_sort(F.array(record_id, mate_id)), "-")))


def in_iupac(code: str, base: Column) -> Column:
    """Whether a base is among those of an ambiguity code."""
    return F.upper(base).isin(*IUPAC[code.upper()])


def significant(x: Column, digits: int) -> Column:
    """A number as text with that many significant digits: zeros at the end stay, digits before the point are never rounded."""
    a = F.abs(x)
    before = (F.floor(F.log10(a)) + 1).cast("int")
    places = F.when(a == 0, 0).when(a >= 1, F.greatest(F.lit(digits) - before, F.lit(0))).otherwise(F.lit(digits) - before)
    return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(F.printf(F.concat(F.lit("%."), places.cast("string"), F.lit("f")), x.cast("double")))


def short_hash(text: Column) -> Column:
    """First eight hexadecimal digits of the SHA-256 hash, in capitals."""
    return F.upper(F.substring(F.sha2(text, 256), 1, 8))


def vaf_density(vaf_dist: Column) -> Column:
    """``vaf=phred,...`` as array of (vaf, phred) in order of vaf; damaged items are left out."""
    items = F.transform(F.split(vaf_dist, ","), lambda x: F.struct(F.element_at(F.split(x, "="), 1).try_cast("double").alias("vaf"), F.try_element_at(F.split(x, "="), F.lit(2)).try_cast("double").alias("phred")))
    return F.array_sort(F.filter(items, lambda x: x["vaf"].isNotNull() & x["phred"].isNotNull()))


def format_density(density: Column) -> Column:
    """The inverse of ``vaf_density``: three decimals for the frequency, two for the score."""
    return F.array_join(F.transform(F.array_sort(density), lambda x: F.format_string("%.3f=%.2f", x["vaf"], x["phred"])), ",")


def anonymise_bases(seq: Column, permutation: str) -> Column:
    """Bases mapped by a permutation of ACGT, in both cases; other characters stay."""
    if sorted(permutation) != list("ACGT"):
        raise ValueError("a permutation of ACGT is needed")
    return F.translate(seq, "ACGTacgt", permutation + permutation.lower())


def anonymous_name(name: Column, secret: str) -> Column:
    """A read name that can't be traced, in the form of a UUID: the same for the same name and secret, so that mates stay together."""
    h = F.sha2(F.concat(F.lit(secret), name), 256)
    part = lambda i, n: F.substring(h, i, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))


def ploidy_of(contig: Column, sex: Column, table: dict[str, dict[str, int] | int]) -> Column:
    """Ploidy by contig, with a common value under ``all`` and values per sex where given."""

    def value(v) -> Column:
        if isinstance(v, dict):
            out = F.lit(None).cast("int")
            for k, n in v.items():
                out = F.when(sex == k, n).otherwise(out)
            return out
        return F.lit(v)

    out = value(table["all"]) if "all" in table else F.lit(None).cast("int")
    for k, v in table.items():
        if k != "all":
            out = F.when(contig == k, value(v)).otherwise(out)
    return out
