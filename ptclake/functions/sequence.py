"""Column functions on nucleotide strings. Positions are 1-based; null sequences give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, codons in the order T, C, A, G at each place.
_AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
STOPS = ("TAA", "TAG", "TGA")


def _positions(first: Column | int, last: Column, step: int = 1) -> Column:
    """first, first + step, ... up to last; empty when there is none."""
    first = first if isinstance(first, Column) else F.lit(first)
    return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgtUu", "TGCAtgcaAa"))


def base_content(seq: Column, bases: str, first: int | None = None, last: int | None = None) -> Column:
    """Share of ``bases`` over the full length (N counts in it), or over the first or last so many; null if shorter than that or empty."""
    part, n = seq, F.length(seq)
    if first:
        part, n = F.when(n >= first, F.substring(seq, 1, first)), F.lit(first)
    elif last:
        part, n = F.when(n >= last, F.substring(seq, -last, last)), F.lit(last)
    return F.when(n > 0, (F.length(part) - F.length(F.translate(part, bases, ""))) / n)


def log2_length(seq: Column, edge: int) -> Column:
    """struct(length, log2, cat): bins (0, edge] (0 included) and above, of the log2."""
    n = F.length(seq)
    log = F.when(n > 0, F.log2(n.cast("double")))
    return F.struct(n.alias("length"), log.alias("log2"), F.when(log <= edge, f"<={edge}").when(log > edge, f">{edge}").alias("cat"))


def positions_of(seq: Column, words: tuple[str, ...], start: Column | int = 1, step: int = 1) -> Column:
    """Starts of any of the words (of one length), from ``start`` on, every ``step``."""
    k = len(words[0])
    return F.filter(_positions(start, F.length(seq) - k + 1, step), lambda i: F.substring(seq, i, k).isin(*words))


def has_uorf(seq: Column) -> Column:
    """Any ATG with a stop behind it in frame."""
    return seq.rlike(f"ATG(?:[\\s\\S]{{3}})*?(?:{'|'.join(STOPS)})")


def inframe_atgs(cds: Column) -> Column:
    """ATG positions in frame, the first base's position each."""
    return positions_of(cds, ("ATG",), 1, 3)


def codons(cds: Column) -> Column:
    """Whole codons in order; a trailing part is dropped."""
    return F.transform(_positions(1, F.length(cds) - 2, 3), lambda i: F.substring(cds, i, 3))


def codon_optimality(cds: Column, offset: Column, optimal: list[str], flank: int = 100, same_chrom: Column | None = None) -> Column:
    """struct(whole, window, status): share of optimal codons (U read as T), of all and of those within ``flank`` of a 0-based offset.

    Codons with N are removed before counting; window codons are lo//3 to hi//3. Where ``same_chrom`` (the variant lies on its transcript's chromosome)
    is false, there are no shares, and the status is chr_mismatch.
    """
    good = [c.upper().replace("U", "T") for c in optimal]
    c = F.filter(codons(cds), lambda x: ~x.contains("N"))
    share = lambda part: F.when(F.size(part) > 0, F.size(F.filter(part, lambda x: x.isin(*good))) / F.size(part))
    lo = F.greatest(F.lit(0), offset - flank)
    hi = F.least(F.length(cds) - 1, offset + flank)
    first, last = F.floor(lo / 3).cast("int"), F.floor(hi / 3).cast("int")
    inside = (offset >= 0) & (offset < F.length(cds))
    elsewhere = ~same_chrom if same_chrom is not None else F.lit(False)
    none = cds.isNull() | (cds == "")
    here = F.coalesce(~elsewhere, F.lit(True))
    status = F.when(none, "no_tx_or_no_cds").when(elsewhere, "chr_mismatch").when(~inside, "ptc_not_in_cds").otherwise("ok")
    return F.struct(F.when(here, share(c)).alias("whole"), F.when(inside & here, share(F.slice(c, first + 1, F.greatest(F.lit(0), last - first + 1)))).alias("window"), status.alias("status"))


def amino_acid(codon: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])
    return F.element_at(table, codon)


def ptc_amino_acids(cds: Column, codon: Column) -> Column:
    """Residues 2 and 1 before and 1 and 2 after a codon number (1-based), and whether each is glycine."""
    c = codons(cds)
    fields = []
    for name, d in (("minus2", -2), ("minus1", -1), ("plus1", 1), ("plus2", 2)):
        aa = amino_acid(F.get(c, codon.cast("int") - 1 + d))
        fields += [aa.alias(name), (aa == "G").alias(f"{name}_gly")]
    return F.struct(*fields)


def readthrough_context(cds: Column, pos: Column, ref: Column, alt: Column, shift: int = 3, reach: int = 6) -> Column:
    """The 12 bases around the stop that an SNV at a coding position makes: 3 before, the stop, 6 after.

    The reference base is looked for within ``shift`` of the position, nearest first (before, then after); then the first in-frame stop within
    ``reach`` codons' bases of the variant's codon is taken, nearest first. Null where either is missing or the context is cut.
    """
    shifts = [0, *[s for d in range(1, shift + 1) for s in (-d, d)]]
    at = F.coalesce(*[F.when(F.substring(cds, (pos + s).cast("int"), 1) == ref, pos + s) for s in shifts]).cast("int")
    made = F.concat(F.substring(cds, F.lit(1), at - 1), alt, F.substring(cds, at + 1, F.length(cds)))
    first = (F.floor((at - 1) / 3) * 3 + 1).cast("int")
    near = [0, *[s for d in range(3, reach + 1, 3) for s in (-d, d)]]
    stop = F.coalesce(*[F.when((first + s >= 1) & F.substring(made, first + s, 3).isin(*STOPS), first + s) for s in near])
    return F.when((stop > 3) & (stop + 8 <= F.length(made)), F.substring(made, stop - 3, 12))


#: Fixed points of the readthrough score: by stop codon, the base at a place behind it to its points.
STOP_POINTS = {"TGA": 40, "TAG": 25, "TAA": 10}
PLUS4_POINTS = {"C": 20, "T": 15, "A": 5, "G": 5}
PLUS5_POINTS = {"TAA": {"C": 6, "G": 6, "T": 2, "A": 2}, "TAG": {"T": 6, "C": 2, "G": 2, "A": 2}, "TGA": {"A": 6, "T": 4, "C": 2, "G": 2}}
PLUS6_POINTS = {"TAA": {"C": 3, "G": 3, "A": 1, "T": 1}, "TAG": {"A": 3, "T": 3, "C": 1, "G": 1}, "TGA": {"A": 3, "T": 3, "C": 1, "G": 1}}
PLUS7_POINTS = {"TAA": {"C": 2, "G": 2, "A": 1, "T": 1}, "TAG": {"A": 2, "T": 2, "C": 1, "G": 1}, "TGA": {"A": 2, "T": 2, "C": 1, "G": 1}}
PLUS8_POINTS = 2
PLUS9_POINTS = {"TAA": ("C", 5, 2), "TAG": ("A", 5, 2), "TGA": ("A", 5, 2)}
FIRST_BASE_POINTS = ("T", 6, 2)
HIGHEST_POINTS = 84


def readthrough_score(context: Column) -> Column:
    """struct(score, category): points of a 12-base context over 84, in 100, two decimals; at least 70, 50, 30. Null unless 12 bases with a stop."""
    stop = F.substring(context, 4, 3)

    def points(table: dict, base: Column) -> Column:
        out = F.lit(0)
        for key, value in table.items():
            out = F.when(base == key, value).otherwise(out)
        return out

    total = points(STOP_POINTS, stop) + points(PLUS4_POINTS, F.substring(context, 7, 1)) + PLUS8_POINTS
    for place, by_stop in ((8, PLUS5_POINTS), (9, PLUS6_POINTS), (10, PLUS7_POINTS)):
        for codon, table in by_stop.items():
            total = total + F.when(stop == codon, points(table, F.substring(context, place, 1))).otherwise(0)
    for codon, (base, hit, miss) in PLUS9_POINTS.items():
        total = total + F.when(stop == codon, F.when(F.substring(context, 12, 1) == base, hit).otherwise(miss)).otherwise(0)
    total = total + F.when(F.substring(context, 1, 1) == FIRST_BASE_POINTS[0], FIRST_BASE_POINTS[1]).otherwise(FIRST_BASE_POINTS[2])
    score = F.round(F.least(total, F.lit(HIGHEST_POINTS)) / HIGHEST_POINTS * 100, 2)
    ok = (F.length(context) == 12) & stop.isin(*STOPS)
    return F.struct(F.when(ok, score).alias("score"), F.when(ok, F.when(score >= 70, "high").when(score >= 50, "moderate").when(score >= 30, "low").otherwise("very_low")).alias("category"))


def kozak(seq: Column, at: Column, need_ten: bool = False) -> Column:
    """struct(window, score, strength) of an AUG at a 1-based position: -3 A 3 or G 2, the fifth base G 3, -6 A 1, the fourth base C 1.

    The window is 9 before to 7 from the AUG on; with ``need_ten`` a shorter window has no points.
    """
    base = lambda d: F.when(at + d >= 1, F.substring(seq, (at + d).cast("int"), 1))
    from_ = F.greatest(F.lit(1), at - 9)
    window = F.substring(seq, from_.cast("int"), F.lit(16) - F.greatest(F.lit(0), F.lit(10) - at).cast("int"))
    hit = lambda d, b, n: F.when(base(d) == b, n).otherwise(0)
    score = hit(-3, "A", 3) + hit(-3, "G", 2) + hit(4, "G", 3) + hit(-6, "A", 1) + hit(3, "C", 1)
    if need_ten:
        score = F.when(F.length(window) >= 10, score).otherwise(0)
    ok = (at >= 1) & (at + 2 <= F.length(seq))
    return F.struct(F.when(ok, window).otherwise("").alias("window"), F.when(ok, score).otherwise(0).alias("score"), F.when(~F.coalesce(ok, F.lit(False)), "insufficient_sequence").when(score >= 5, "strong").when(score >= 3, "moderate").when(score >= 1, "weak").otherwise("very_weak").alias("strength"))


def downstream_augs(cds: Column, ptc: Column) -> Column:
    """First AUG behind the stop codon at a 1-based position: in frame (searched from the next codon) and shifted by 1 and 2, with distances.

    struct(inframe, inframe_distance, plus1_distance, plus2_distance); distances are from the stop's first base.
    """
    first = lambda start: F.array_min(positions_of(cds, ("ATG",), start, 3))
    a, b, c = first(ptc + 3), first(ptc + 1), first(ptc + 2)
    return F.struct(a.alias("inframe"), (a - ptc).alias("inframe_distance"), (b - ptc).alias("plus1_distance"), (c - ptc).alias("plus2_distance"))


def transcript_distances(codon: Column, total_codons: Column) -> Column:
    """Codons and bases to the start and the end, and percent of the way."""
    return F.struct((codon - 1).alias("codons_to_start"), ((codon - 1) * 3).alias("nt_to_start"), (total_codons - codon).alias("codons_to_end"), ((total_codons - codon) * 3).alias("nt_to_end"), F.round(codon / total_codons * 100, 2).alias("percent"))
