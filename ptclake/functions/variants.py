"""Column functions on variants: names, keys, annotations, labels, bins and the rule tree. Null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def harmonize_chrom(chrom: Column, prefix: bool = True) -> Column:
    """With the prefix ``chr``, or without."""
    bare = F.regexp_replace(chrom, "^chr", "")
    return F.concat(F.lit("chr"), bare) if prefix else bare


def strip_version(name: Column, first_dot: bool = False) -> Column:
    """Drops a trailing ``.N``; with ``first_dot`` all from the first dot on."""
    return F.split(name, r"\.", 2)[0] if first_dot else F.regexp_replace(name, r"\.\d+$", "")


def variant_id(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """``chrom_pos_ref_alt``; null where a part is."""
    return F.concat(chrom, F.lit("_"), pos.cast("string"), F.lit("_"), ref, F.lit("_"), alt)


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """``chrom:pos_ref>alt``."""
    return F.concat(chrom, F.lit(":"), pos.cast("string"), F.lit("_"), ref, F.lit(">"), alt)


def parse_variant_id(name: Column) -> Column:
    """Either form to struct(chrom, pos, ref, alt); null fields where it has none."""
    parts = F.split(F.regexp_replace(name, "[:>]", "_"), "_")
    return F.struct(F.get(parts, F.lit(0)).alias("chrom"), F.get(parts, F.lit(1)).try_cast("long").alias("pos"), F.get(parts, F.lit(2)).alias("ref"), F.get(parts, F.lit(3)).alias("alt"))


def split_txnames(txnames: Column) -> Column:
    """Transcript names between ``; , |`` or spaces, without versions; empty names are dropped."""
    return F.transform(F.filter(F.split(txnames, r"[;,|\s]+"), lambda x: x != ""), lambda x: strip_version(x))


def parse_annotations(v3: Column) -> Column:
    """``GENE:TX:exon:c.x:p.y,...`` to an array of structs gene, tx, exon, c_change, p_change, coding_pos, ref, alt, protein_pos."""

    def one(entry: Column) -> Column:
        f = F.split(entry, ":")
        at = lambda k: F.coalesce(F.get(f, F.lit(k)), F.lit(""))
        snv = lambda g: F.regexp_extract(at(3), r"c\.([ACGT])(\d+)([ACGT])", g)
        return F.struct(
            at(0).alias("gene"), strip_version(at(1)).alias("tx"), at(2).alias("exon"), at(3).alias("c_change"), at(4).alias("p_change"), coding_pos(at(3)).alias("coding_pos"),
            F.nullif(snv(1), F.lit("")).alias("ref"), F.nullif(snv(3), F.lit("")).alias("alt"), F.regexp_extract(at(4), r"p\.[A-Z*](\d+)[X*]", 1).try_cast("long").alias("protein_pos"),
        )

    return F.transform(F.filter(F.split(v3, ","), lambda x: x != ""), one)


def coding_pos(c_change: Column) -> Column:
    """Digits of a c. field; of a range, those before ``_``."""
    return F.regexp_replace(F.split(c_change, "_")[0], r"\D", "").try_cast("long")


def coerce_bool(value: Column) -> Column:
    """TRUE/T/1/yes/y and FALSE/F/0/no/n/'' in any case; labels of the position flags count as true; else null."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("true", "t", "1", "yes", "y", "lastexon"), True).when(v.isin("false", "f", "0", "no", "n", ""), False)


def coerce_numeric(value: Column) -> Column:
    """A double, null where it isn't a number ('NA', '.')."""
    return F.trim(value.cast("string")).try_cast("double")


def map_target(label: Column) -> Column:
    """TRUE/FALSE to 1/0; else null."""
    return coerce_bool(F.nullif(F.trim(label.cast("string")), F.lit(""))).cast("int")


def allele_ratios(ref: Column, alt: Column, total: Column) -> Column:
    """struct(alt_loss = 1 - alt/total, ref_share = ref/(ref+alt), log_ratio = -log2((alt+1)/(ref+1))); null on zero depth."""
    div = lambda a, b: F.when(b != 0, a / b)
    return F.struct((1 - div(alt, total)).alias("alt_loss"), div(ref, ref + alt).alias("ref_share"), F.log2((ref + 1) / (alt + 1)).alias("log_ratio"))


def label_escape(ratio: Column) -> Column:
    """0.35 <= ratio <= 0.65 is escape (true), above 0.65 not (false), else null."""
    low, high = ESCAPE_RATIOS
    return F.when((ratio >= low) & (ratio <= high), True).when(ratio > high, False)


# Cut-offs and names that results must agree on.
ESCAPE_RATIOS = (0.35, 0.65)
TIERS = ((0.20, "High-confidence NMD"), (0.35, "Likely NMD"), (0.65, "Ambiguous"), (0.80, "Likely escape"))
LAST_TIER = "High-confidence escape"
POSITION_EDGES = [0, 100, 200, 300, 700]
DOWNSTREAM_EJC_EDGES = [2, 5, 9, 14]
LOEUF_EDGES, PLI_EDGES = (0.2, 0.6), (0.35, 0.65)
PHASTCONS_EDGES, PHYLOP_EDGES = (0.1, 0.5), (0.5, 2.0)
AUG_DISTANCES = ((50, "very_close"), (100, "close"), (200, "moderate"), (500, "far"))
#: The rule tree: score and rule of each leaf in the order of the tests, its two limits, and the scores between classes.
RULE_LEAVES = {"last_exon": 0.0, "start_proximal": 0.12, "long_exon": 0.41, "50nt_rule": 0.20, "trigger": 0.65}
START_PROXIMAL, LONG_EXON = 150, 407
TRIGGERING_ABOVE, EVADING_BELOW = 0.52, 0.25


def assign_tier(probability: Column) -> Column:
    """Tiers [low, high) at the edges of TIERS; ``Unknown`` for null."""
    out = F.when(probability.isNull(), "Unknown")
    for edge, name in TIERS:
        out = out.when(probability < edge, name)
    return out.otherwise(LAST_TIER)


def cut(value: Column, edges: list[float], labels: list[str], right: bool = False, include_edge: bool = True) -> Column:
    """R's cut: bins [a, b), or (a, b] with ``right``; ``include_edge`` closes the outer edge too. Null outside."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    last = len(labels) - 1
    for k, label in enumerate(labels):
        a, b = edges[k], edges[k + 1]
        low = value > a if right and not (include_edge and k == 0) else value >= a
        high = value <= b if right or (include_edge and k == last) else value < b
        out = out.when(low & high, label)
    return out


def position_bin(distance: Column) -> Column:
    """Bins 0-100, 100-200, 200-300, 300-700 and from 700, left-closed; the last is open-ended."""
    return cut(distance, [*POSITION_EDGES, float("inf")], ["0-100", "100-200", "200-300", "300-700", "700+"])


def downstream_ejc_bin(count: Column) -> Column:
    """Right-closed bins at 2, 5, 9, 14."""
    return cut(count, [float("-inf"), *DOWNSTREAM_EJC_EDGES, float("inf")], ["0-2", "3-5", "6-9", "10-14", "15+"], right=True)


def constraint_bins(loeuf: Column, pli: Column) -> Column:
    """LOEUF at 0.2 and 0.6, pLI at 0.35 and 0.65."""
    (a, b), (c, d) = LOEUF_EDGES, PLI_EDGES
    return F.struct(F.when(loeuf < a, "constrained").when(loeuf < b, "intermediate").when(loeuf >= b, "tolerant").alias("loeuf_cat"), F.when(pli < c, "low").when(pli <= d, "intermediate").when(pli > d, "high").alias("pli_cat"))


def conservation_bins(phastcons: Column, phylop: Column) -> Column:
    """phastCons at 0.1 and 0.5, phyloP at 0.5 and 2."""
    three = lambda x, a, b: F.when(x < a, "low").when(x < b, "medium").when(x >= b, "high")
    return F.struct(three(phastcons, *PHASTCONS_EDGES).alias("phastcons_cat"), three(phylop, *PHYLOP_EDGES).alias("phylop_cat"))


def aug_distance_bin(distance: Column) -> Column:
    """Null is no_inframe_AUG; edges 50, 100, 200, 500."""
    out = F.when(distance.isNull(), "no_inframe_AUG")
    for edge, name in AUG_DISTANCES:
        out = out.when(distance < edge, name)
    return out.otherwise("very_far")


def aug_frame_status(plus1: Column, plus2: Column) -> Column:
    """Which of the other frames has a downstream AUG."""
    return F.when(plus1.isNotNull() & plus2.isNotNull(), "both").when(plus1.isNotNull(), "plus1").when(plus2.isNotNull(), "plus2").otherwise("none")


def rule_tree(last_exon: Column, dist_to_start: Column, exon_length: Column, penult_last50: Column) -> Column:
    """struct(score, rule, class): the first branch that holds decides; a branch whose input is missing makes all null."""
    tests = {"last_exon": last_exon, "start_proximal": dist_to_start < START_PROXIMAL, "long_exon": exon_length > LONG_EXON, "50nt_rule": penult_last50}
    score, rule = F.when(F.lit(False), F.lit(None).cast("double")), F.when(F.lit(False), F.lit(None).cast("string"))
    for name, test in tests.items():
        score, rule = score.when(test.isNull(), None).when(test, RULE_LEAVES[name]), rule.when(test.isNull(), None).when(test, name)
    score, rule = score.otherwise(RULE_LEAVES["trigger"]), rule.otherwise("trigger")
    kind = F.when(score > TRIGGERING_ABOVE, "NMD_triggering").when(score < EVADING_BELOW, "NMD_evading").when(score.isNotNull(), "intermediate")
    return F.struct(score.alias("score"), rule.alias("rule"), kind.alias("class"))


def ptc_distances(pos: Column, ends: Column) -> Column:
    """From a coding position and the cumulative coding exon ends: the mutated exon (first end >= position) and distances.

    struct(mut_exon, exon_count, exon_start, exon_end, exon_length, to_exon_start, to_exon_end, to_start, to_end, relative, relative_in_exon,
    exons_before, exons_after, last_exon, last_exon_strict (null for one exon), long_exon, first_100, first_200, penultimate_last50, penultimate).
    All null past the last end.
    """
    n = F.size(ends)
    after = F.filter(ends, lambda e: e >= pos)
    k = n - F.size(after) + 1
    ok = (F.size(after) > 0) & (pos >= 1)
    end, total = F.get(ends, k - 1), F.get(ends, n - 1)
    start = F.when(k > 1, F.get(ends, k - 2)).otherwise(F.lit(0)) + 1
    length = end - start + 1
    penultimate = n == k + 1
    fields = {
        "mut_exon": k, "exon_count": n, "exon_start": start, "exon_end": end, "exon_length": length, "to_exon_start": pos - start, "to_exon_end": end - pos, "to_start": pos, "to_end": total - pos,
        "relative": pos / total, "relative_in_exon": (pos - start + 1) / length, "exons_before": k - 1, "exons_after": n - k, "last_exon": k == n, "last_exon_strict": F.when(n > 1, k == n), "long_exon": length >= 400,
        "first_100": pos <= 100, "first_200": pos <= 200, "penultimate_last50": penultimate & (end - 50 <= pos) & (length >= 50), "penultimate": penultimate,
    }
    return F.struct(*[F.when(ok, v).alias(name) for name, v in fields.items()])


def last_ejc(k: Column, n: Column, to_exon_end: Column, exon_length: Column) -> Column:
    """last.exon, penultimate.last50bp (at most 50 from the end of an exon of 50 or more) or upstream; one coding exon is last.exon."""
    return F.when(k.isNull(), None).when(k == n, "last.exon").when((k == n - 1) & (to_exon_end <= 50) & (exon_length >= 50), "penultimate.last50bp").otherwise("upstream")
