"""Artifacts: six kinds of bias that can make a pileup look like a variant.

Each artifact is a hypothesis of its own beside the one without bias.  Its probabilities per
observation are expressions; whether it is possible, informative and likely for a variant is
decided from counts per pileup, which are partial aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.functions import logprob as lp
from tesseral.model import observations as ob

#: Artifact and its symbols of strand, orientation, position, softclip, homopolymer and alternative locus.
SYMBOLS = {"none": "......", "forward": "+.....", "reverse": "-.....", "f1r2": ".>....", "f2r1": ".<....", "position": "..^...", "softclip": "...$..", "homopolymer": "....*.", "alt_locus": ".....*"}
ARTIFACTS = tuple(a for a in SYMBOLS if a != "none")
#: Strong observations needed, and the share of them that must show the bias.
LEAST_STRONG, STRONG_SHARE, HOMOPOLYMER_SHARE = 10, 0.66666, 0.01


@dataclass(frozen=True)
class Applicable:
    """Which biases a variant can have: small precise variants all, others fewer."""

    orientation: bool = True
    strand: bool = True
    position: bool = True
    softclip: bool = True
    homopolymer: bool = True
    alt_locus: bool = True

    def artifacts(self) -> tuple[str, ...]:
        have = {"forward": self.strand, "reverse": self.strand, "f1r2": self.orientation, "f2r1": self.orientation, "position": self.position, "softclip": self.softclip, "homopolymer": self.homopolymer, "alt_locus": self.alt_locus}
        return tuple(a for a in ARTIFACTS if have[a])


def applicable(small: Column, precise: Column, has_homopolymer: Column) -> Column:
    """Struct of the biases that a variant can have: orientation, position and softclip for precise SNV and MNV only."""
    return F.struct((small & precise).alias("orientation"), precise.alias("strand"), (small & precise).alias("position"), (small & precise).alias("softclip"), has_homopolymer.alias("homopolymer"), F.lit(True).alias("alt_locus"))


def _one() -> Column:
    return F.lit(0.0)


def _half() -> Column:
    return F.lit(ob.LN_HALF)


def _only(condition: Column) -> Column:
    """One where a condition holds, zero elsewhere."""
    return F.when(condition, _one()).otherwise(lp.zero())


def _not_hit() -> Column:
    hit = F.col("ln_hit_base")
    return F.when(hit == 0, _one()).otherwise(lp.one_minus(hit))


def _position() -> Column:
    return F.when(F.col("read_position") == "Major", F.col("ln_hit_base")).otherwise(_not_hit())


def alt_parts(artifact: str) -> list[Column]:
    """Log probability of an observation's six features if it comes from the alternative allele.

    Uses ``forward_rate`` and ``has_alt_loci``, which ``learned`` adds per variant.
    """
    strand, orientation, clip = F.col("strand"), F.col("read_orientation"), F.col("softclipped")
    if artifact in ("forward", "reverse"):
        side = "Forward" if artifact == "forward" else "Reverse"
        s = F.when(strand == "None", _one()).otherwise(_only(strand == side))
    else:
        rate = F.when(strand == "Forward", F.col("forward_rate")).otherwise(1 - F.col("forward_rate"))
        s = F.when(strand == "None", _one()).when(strand == "Both", F.col("ln_double")).otherwise(lp.ln(rate) + F.col("ln_single"))
    if artifact in ("f1r2", "f2r1"):
        ours, other = ("F1R2", "F2R1") if artifact == "f1r2" else ("F2R1", "F1R2")
        o = F.when(orientation == ours, _one()).when(orientation == other, lp.zero()).otherwise(_half())
    else:
        o = _half()
    p = _only(F.col("read_position") == "Major") if artifact == "position" else _position()
    c = _only(clip) if artifact == "softclip" else _one()
    h = F.coalesce(F.col("ln_homopolymer_artifact" if artifact == "homopolymer" else "ln_homopolymer_variant"), _one())
    if artifact == "alt_locus":
        a = F.when(F.col("has_alt_loci"), _only(F.col("alt_locus") == "Major")).otherwise(_only(~F.col("is_max_mapq")))
    else:
        a = _half()
    return [s, o, p, c, h, a]


def ref_parts(artifact: str) -> list[Column]:
    """The same if it comes from the reference allele."""
    h = F.coalesce(F.col("ln_homopolymer_artifact" if artifact == "homopolymer" else "ln_homopolymer_variant"), _one())
    a = F.when(F.col("has_alt_loci"), _only(F.col("alt_locus") != "Major")).otherwise(_half()) if artifact == "alt_locus" else _half()
    return [_half(), _half(), _position(), _one(), h, a]


def any_parts() -> list[Column]:
    """The same if it is mismapped."""
    return [_half(), _half(), _position(), _one(), _one(), _half()]


def total(parts: list[Column]) -> Column:
    """Sum of log probabilities."""
    out = parts[0]
    for x in parts[1:]:
        out = out + x
    return out


def forward_rate(all_strong: Column, forward: Column) -> Column:
    """Share of forward reads among those of the reference: any within (0, 1) of over 100, 0.5 where it is near, else null."""
    share = F.try_divide(forward, all_strong)
    return F.when((all_strong > 100) & (share > 0) & (share < 1), share).when((all_strong > 2) & share.between(0.4, 0.6), F.lit(0.5))


def pileup_counts(obs: DataFrame) -> DataFrame:
    """Counts per variant and sample from which all artifacts are judged."""
    alt, ref, unique = ob.strong_alt(), ob.strong_ref(), ob.unique_mapping()
    mapped = F.exp("ln_map")
    strand, orientation = F.col("strand"), F.col("read_orientation")
    standard = orientation.isin("F1R2", "F2R1")
    length = F.coalesce(F.col("homopolymer_len"), F.lit(0))
    seen = {
        "forward": strand.isin("None", "Forward"),
        "reverse": strand.isin("None", "Reverse"),
        "f1r2": orientation != "F2R1",
        "f2r1": orientation != "F1R2",
        "position": F.col("read_position") == "Major",
        "softclip": F.col("softclipped"),
        "homopolymer": length != 0,
        "alt_locus": F.when(F.col("has_alt_loci"), F.col("alt_locus") == "Major").otherwise(~F.col("is_max_mapq")),
    }
    return obs.groupBy("variant", "sample").agg(
        F.count("*").alias("n"),
        F.count_if(unique & alt).alias("n_strong"),
        F.bool_and(F.col("ln_ref") > F.col("ln_alt")).alias("all_ref"),
        F.bool_and(ob.positive_ref()).alias("all_positive_ref"),
        *(F.count_if(unique & alt & x).alias(f"strong_{a}") for a, x in seen.items()),
        *(F.coalesce(F.bool_or(x), F.lit(False)).alias(f"any_{a}") for a, x in seen.items()),
        F.sum(F.when(ref & (strand != "Both"), mapped).otherwise(0.0)).alias("ref_one_strand"),
        F.sum(F.when(ref & (strand == "Forward"), mapped).otherwise(0.0)).alias("ref_forward"),
        F.count_if(~standard).alias("n_uncertain"),
        F.count_if(ref & standard).alias("ref_oriented"),
        F.count_if(ref & (orientation == "F1R2")).alias("ref_f1r2"),
        F.sum(F.when(ref, mapped).otherwise(0.0)).alias("ref_expected"),
        F.sum(F.when(ref & (F.col("read_position") == "Major"), mapped).otherwise(0.0)).alias("ref_major"),
        F.sum(F.when(ref, F.exp(F.col("ln_map") + F.col("ln_hit_base"))).otherwise(0.0)).alias("ref_hit"),
        F.count_if(F.col("softclipped")).alias("n_clipped"),
        F.count_if(alt).alias("n_alt"),
        F.count_if(alt & ~F.col("is_max_mapq")).alias("alt_low"),
        F.count_if(ref).alias("n_ref"),
        F.count_if(ref & ~F.col("is_max_mapq")).alias("ref_low"),
        F.count_if(length > 0).alias("n_longer"),
        F.count_if(length < 0).alias("n_shorter"),
        F.count_if(F.col("alt_locus") != "None").alias("n_loci"),
    )


def learned(obs: DataFrame) -> DataFrame:
    """Observations with what is learned from all pileups of their variant: ``forward_rate`` (0.5 if unknown) and ``has_alt_loci``."""
    ref = ob.strong_ref()
    mapped = F.exp("ln_map")
    per = obs.groupBy(F.col("variant").alias("__v")).agg(
        F.sum(F.when(ref & (F.col("strand") != "Both"), mapped).otherwise(0.0)).alias("__all"),
        F.sum(F.when(ref & (F.col("strand") == "Forward"), mapped).otherwise(0.0)).alias("__fwd"),
        F.coalesce(F.bool_or(F.col("alt_locus") != "None"), F.lit(False)).alias("has_alt_loci"),
    )
    per = per.select("__v", F.coalesce(forward_rate(F.col("__all"), F.col("__fwd")), F.lit(0.5)).alias("forward_rate"), "has_alt_loci")
    return obs.join(per, F.col("variant") == F.col("__v")).drop("__v")


def judged(counts: DataFrame) -> DataFrame:
    """Per variant, whether each artifact is to be considered: ``ok_<artifact>``, possible and informative and likely."""

    def likely(a: str) -> Column:
        share = F.try_divide(F.col(f"strong_{a}"), F.col("n_strong"))
        return F.when(F.col("n_strong") >= LEAST_STRONG, share >= STRONG_SHARE).otherwise(~F.col("all_ref") & (F.col("n") > 0))

    both_ways = (F.col("n_alt") == 0) | ((F.col("n_longer") > 0) & (F.col("n_shorter") > 0))
    rate_fits = (F.col("ref_expected") > 10) & (F.col("ref_major") > 0) & (F.abs(F.try_divide("ref_major", "ref_expected") - F.col("ref_hit")) < 0.05)
    summed = ("n", "n_uncertain", "ref_oriented", "ref_f1r2", "ref_one_strand", "ref_forward", "n_clipped", "n_alt", "alt_low", "n_ref", "ref_low", "n_loci")
    per = counts.groupBy("variant").agg(
        *(F.sum(c).alias(c) for c in summed),
        *((F.bool_or(likely(a)) & F.bool_or(f"any_{a}")).alias(f"seen_{a}") for a in ARTIFACTS if a != "homopolymer"),
        F.bool_and(both_ways).alias("both_ways"),
        F.bool_or(rate_fits).alias("rate_fits"),
    )
    strand = forward_rate(F.col("ref_one_strand"), F.col("ref_forward")).isNotNull()
    oriented = (F.col("n_uncertain") < F.col("n") / 2.0) & (F.col("ref_oriented") > 2) & F.try_divide("ref_f1r2", "ref_oriented").between(0.3, 0.7)
    loci = (F.col("n_alt") > 0) & (F.col("alt_low") > F.col("n_alt") * 0.1) & (F.col("n_alt") - F.col("alt_low") < 10) & ((F.col("n_loci") > 0) | ((F.col("n_ref") > 0) & (F.col("ref_low") < F.col("n_ref") * 0.9)))
    informative = {"forward": strand, "reverse": strand, "f1r2": oriented, "f2r1": oriented, "position": F.col("rate_fits"), "softclip": F.col("n_clipped") > 0, "alt_locus": loci}
    no = F.lit(False)
    return per.select("variant", *(F.coalesce(F.col(f"seen_{a}") & x, no).alias(f"ok_{a}") for a, x in informative.items()), F.coalesce("both_ways", no).alias("ok_homopolymer"))


def single_artifacts(domains: dict[str, list[str]]) -> list[dict[str, str]]:
    """Of the product of all dimensions' values, those with just one that isn't ``none``: the hypotheses to consider."""
    from itertools import product

    names = list(domains)
    return [dict(zip(names, c)) for c in product(*(domains[n] for n in names)) if sum(x != "none" for x in c) == 1]
