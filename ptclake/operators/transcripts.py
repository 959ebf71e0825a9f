"""Transcript models and the place of a variant on them. Coordinates are 1-based and inclusive; arrays are in transcript order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ptclake.functions.sequence import revcomp
from ptclake.functions.variants import last_ejc, strip_version


def exon_rank(exons: DataFrame) -> DataFrame:
    """``rank`` from exon_number where given, else from the position by strand."""
    order = F.when(F.col("strand") == "+", F.col("start")).otherwise(-F.col("end"))
    number = F.col("exon_number").try_cast("int") if "exon_number" in exons.columns else F.lit(None).cast("int")
    return exons.withColumn("rank", F.coalesce(number, F.row_number().over(Window.partitionBy("tx").orderBy(order))))


def transcript_model(features: DataFrame) -> DataFrame:
    """Rows of features (tx, gene, chrom, strand, feature, start, end) to one row per transcript.

    ``exons``, ``cds`` and ``stop_codon`` are arrays of (start, end), 5' to 3'; ``cds_min`` and ``cds_max`` their genomic ends.
    """
    blocks = lambda kind: F.collect_list(F.when(F.col("feature") == kind, F.struct("start", "end")))
    ordered = lambda c: F.when(F.col("strand") == "+", F.sort_array(c)).otherwise(F.reverse(F.sort_array(c)))
    g = features.groupBy("tx").agg(F.min("gene").alias("gene"), F.min("chrom").alias("chrom"), F.min("strand").alias("strand"), blocks("exon").alias("exons"), blocks("CDS").alias("cds"), blocks("stop_codon").alias("stop_codon"), F.min(F.when(F.col("feature") == "CDS", F.col("start"))).alias("cds_min"), F.max(F.when(F.col("feature") == "CDS", F.col("end"))).alias("cds_max"))
    return g.select("tx", "gene", "chrom", "strand", *[ordered(F.col(c)).alias(c) for c in ("exons", "cds", "stop_codon")], "cds_min", "cds_max")


def block_length(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + b["end"] - b["start"] + 1)


def cumulative_ends(blocks: Column) -> Column:
    """Cumulative lengths of blocks in order."""
    return F.transform(blocks, lambda b, i: block_length(F.slice(blocks, F.lit(1), i + 1)))


def overlaps_any(block: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] <= block["end"]) & (block["start"] <= o["end"]))


def locate(blocks: Column, strand: Column, pos: Column) -> Column:
    """struct(rank, count, offset, length, to_end, spliced): the block with a genomic position; null where none has it.

    ``offset`` is 1-based from the block's 5' end, ``spliced`` counts the bases of blocks before it too.
    """
    rank = F.array_position(F.transform(blocks, lambda b: pos.between(b["start"], b["end"])), True).cast("int")
    b = F.get(blocks, rank - 1)
    offset = F.when(strand == "+", pos - b["start"]).otherwise(b["end"] - pos) + 1
    length = b["end"] - b["start"] + 1
    before = block_length(F.slice(blocks, F.lit(1), rank - 1))
    return F.when(rank > 0, F.struct(rank.alias("rank"), F.size(blocks).alias("count"), offset.alias("offset"), length.alias("length"), (length - offset).alias("to_end"), (before + offset).alias("spliced"), b["start"].alias("start"), b["end"].alias("end")))


def locate_ptc(variants: DataFrame, model: DataFrame) -> DataFrame:
    """Variants (id, tx, pos) on their transcripts: exon and coding-exon ranks, the CDS position, and the last-junction class.

    A coding exon overlaps the CDS or the stop codon; the relative location is the CDS position over CDS and stop length.
    """
    j = variants.join(model, "tx")
    exon = locate(F.col("exons"), F.col("strand"), F.col("pos"))
    coding = F.filter("exons", lambda e: overlaps_any(e, F.col("cds")) | overlaps_any(e, F.col("stop_codon")))
    out = j.withColumn("exon", exon).withColumn("coding", coding).withColumn("at", locate(F.col("coding"), F.col("strand"), F.col("pos"))).withColumn("in_cds", locate(F.col("cds"), F.col("strand"), F.col("pos")))
    total = block_length(F.col("cds")) + block_length(F.col("stop_codon"))
    seg = lambda e: F.greatest(F.lit(0), e["end"] - e["start"] + 1)
    return out.select(
        "id", "tx", "gene", "strand", "pos", F.col("exon.rank").alias("exon_rank"), F.col("exon.count").alias("exon_count"), F.col("exon.offset").alias("exon_offset"), F.col("exon.to_end").alias("to_exon_end"), seg(F.col("exon")).alias("exon_length"),
        F.col("at.rank").alias("coding_rank"), F.col("at.count").alias("coding_count"), (F.col("at.count") - F.col("at.rank")).alias("exons_after"), F.col("in_cds.spliced").alias("cds_pos"), total.alias("cds_total"), (F.col("in_cds.spliced") / total).alias("relative"),
        last_ejc(F.col("at.rank"), F.col("at.count"), F.col("in_cds.to_end"), F.col("in_cds.length")).alias("last_ejc"), F.col("in_cds.length").alias("cds_exon_length"), F.col("in_cds.to_end").alias("to_cds_exon_end"),
    )


def exon_counts(model: DataFrame) -> DataFrame:
    """Coding and non-coding exons, and non-coding bases, per transcript; with the cumulative CDS exon ends."""
    coding = F.filter("exons", lambda e: overlaps_any(e, F.col("cds")))
    return model.select("tx", F.size(coding).alias("coding_exons"), (F.size("exons") - F.size(coding)).alias("noncoding_exons"), (block_length(F.col("exons")) - block_length(F.col("cds"))).alias("noncoding_bp"), cumulative_ends(F.col("cds")).alias("cds_exon_ends"))


def transcript_meta(tags: DataFrame, model: DataFrame) -> DataFrame:
    """Per transcript: MANE (1 if any), least APPRIS rank, least support level, CDS and exon length."""
    m = tags.groupBy("tx").agg(F.max("mane").alias("mane"), F.min("appris").alias("appris"), F.min("tsl").alias("tsl"))
    return model.select("tx", block_length(F.col("cds")).alias("cds_length"), block_length(F.col("exons")).alias("exon_length")).join(m, "tx", "left")


def pick_canonical(candidates: DataFrame) -> DataFrame:
    """One transcript per variant (id): MANE, then APPRIS, support level, longest CDS, longest exons, then name; with the reason."""
    order = [F.col("mane").desc_nulls_last(), F.col("appris").asc_nulls_last(), F.col("tsl").asc_nulls_last(), F.col("cds_length").desc(), F.col("exon_length").desc(), F.col("tx")]
    best = candidates.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter("_n = 1").drop("_n")
    return best.withColumn("reason", F.when(F.col("mane") == 1, "MANE").when(F.col("appris").isNotNull(), "APPRIS").when(F.col("tsl").isNotNull(), "TSL").otherwise("longest_CDS"))


def lookup_transcript(names: DataFrame, model_tx: DataFrame) -> DataFrame:
    """Names (id, tx) to a model's transcripts: exact, else without versions (smallest name); flags version_mismatch and tx_not_in_gtf."""
    exact = model_tx.select(F.col("tx").alias("exact"))
    loose = model_tx.groupBy(strip_version(F.col("tx")).alias("bare")).agg(F.min("tx").alias("loose"))
    j = names.join(exact, names["tx"] == F.col("exact"), "left").join(loose, strip_version(names["tx"]) == F.col("bare"), "left")
    found = F.coalesce("exact", "loose")
    return j.select("id", "tx", found.alias("transcript_id_used"), (F.col("exact").isNull() & F.col("loose").isNotNull()).alias("version_mismatch"), found.isNull().alias("tx_not_in_gtf"))


def region_blocks(variants: DataFrame, model: DataFrame, flank: int = 100) -> DataFrame:
    """Regions of a variant as blocks (id, region, chrom, rank, start, end, strand): ptc_100bp, ptc_to_ejc, ejc_100bp, new3utr, old3utr, utr5, tx_whole.

    ptc_to_ejc runs from the stop to its exon's 3' end and is missing at that base; new3utr leaves the stop's base out; the flanks are genomic;
    a transcript without a coding sequence has no old3utr and no utr5.
    """
    j = variants.join(model, "tx").withColumn("e", locate(F.col("exons"), F.col("strand"), F.col("pos"))).filter("e IS NOT NULL")
    plus = F.col("strand") == "+"
    p, block = F.col("pos"), lambda a, b: F.array(F.struct(a.cast("long").alias("start"), b.cast("long").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    end3 = F.when(plus, F.col("e.end")).otherwise(F.col("e.start"))
    clip = lambda lo, hi: F.filter(F.transform("exons", lambda x: F.struct(F.greatest(x["start"], lo).cast("long").alias("start"), F.least(x["end"], hi).cast("long").alias("end"))), lambda x: x["start"] <= x["end"])
    big = F.lit(2**62)
    stop_max, stop_min = F.array_max(F.transform(F.concat("cds", "stop_codon"), lambda x: x["end"])), F.array_min(F.transform(F.concat("cds", "stop_codon"), lambda x: x["start"]))
    coding = F.col("cds_min").isNotNull()
    inner = F.when(plus, F.when(p < end3, block(p, end3))).otherwise(F.when(p > end3, block(end3, p)))
    regions = {
        "ptc_100bp": block(p - flank, p + flank), "ptc_to_ejc": F.coalesce(inner, none), "ejc_100bp": block(end3 - flank, end3 + flank),
        "new3utr": F.when(plus, clip(p + 1, big)).otherwise(clip(F.lit(0), p - 1)), "old3utr": F.when(coding, F.when(plus, clip(stop_max + 1, big)).otherwise(clip(F.lit(0), stop_min - 1))),
        "utr5": F.when(coding, F.when(plus, clip(F.lit(0), F.col("cds_min") - 1)).otherwise(clip(F.col("cds_max") + 1, big))), "tx_whole": clip(F.lit(0), big),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("region"), F.coalesce(v, none).alias("blocks")) for k, v in regions.items()]))
    return j.select("id", "chrom", "strand", each.alias("r")).select("id", "chrom", "strand", F.col("r.region").alias("region"), F.posexplode("r.blocks").alias("i", "b")).select("id", "region", "chrom", "strand", (F.col("i") + 1).alias("rank"), "b.start", "b.end")


def motif_region_blocks(variants: DataFrame, model: DataFrame, flank: int = 100, first: int = 200) -> DataFrame:
    """The regions that motifs are looked for in, of variants (id, tx, coding_pos), as blocks (id, region, chrom, rank, start, end, strand).

    In coding positions: ptc_to_ejc (to the end of the stop's exon), ptc_pm100 and ejc_pm100 (``flank`` bases to either side, cut at the ends of the CDS)
    and newutr_200 (``first`` bases, cut at the CDS's end); utr3_all are the exon parts behind the CDS's last base (a stop codon that the CDS leaves out among them),
    utr3_200 their ``first`` bases, and newutr_all the CDS from the stop on and then the 3' UTR. A place outside of the CDS has no regions.
    """
    p, total, ejc = F.col("coding_pos"), F.col("_total"), F.col("_ejc")
    plus = F.col("strand") == "+"
    one = F.lit(1).cast("long")

    def spans(blocks: str) -> Column:
        """Blocks with their first and last position along them."""
        ends = cumulative_ends(F.col(blocks))
        return F.transform(F.arrays_zip(F.col(blocks).alias("b"), ends.alias("last")), lambda x: F.struct(x["b"]["start"].cast("long").alias("start"), x["b"]["end"].cast("long").alias("end"), (x["last"] - (x["b"]["end"] - x["b"]["start"])).alias("first"), x["last"].alias("last")))

    def part(blocks: str, low: str, high: str) -> Column:
        """Blocks cut to positions low..high along them."""

        def cut(b: Column) -> Column:
            before, behind = F.greatest(F.col(low) - b["first"], F.lit(0)), F.greatest(b["last"] - F.col(high), F.lit(0))
            return F.struct(F.when(plus, b["start"] + before).otherwise(b["start"] + behind).alias("start"), F.when(plus, b["end"] - behind).otherwise(b["end"] - before).alias("end"))

        return F.transform(F.filter(blocks, lambda b: (b["first"] <= F.col(high)) & (b["last"] >= F.col(low))), cut)

    clipped = F.transform("exons", lambda x: F.struct(F.when(plus, F.greatest(x["start"], F.col("cds_max") + 1)).otherwise(x["start"]).cast("long").alias("start"), F.when(plus, x["end"]).otherwise(F.least(x["end"], F.col("cds_min") - 1)).cast("long").alias("end")))
    j = variants.select("id", "tx", F.col("coding_pos").cast("long").alias("coding_pos")).join(model, "tx").withColumn("_total", block_length(F.col("cds"))).filter(p.between(1, total))
    # what the blocks' functions read are columns, so nothing is worked out for each block again
    j = j.withColumn("_utr", F.filter(clipped, lambda x: x["start"] <= x["end"])).withColumns({"_cds": spans("cds"), "_utr_spans": spans("_utr")})
    j = j.withColumn("_ejc", F.get(F.filter("_cds", lambda b: b["last"] >= p), F.lit(0))["last"])
    j = j.withColumns({"_one": one, "_first": F.lit(first).cast("long"), "_to": F.least(p + first - 1, total), "_low": F.greatest(one, p - flank), "_high": F.least(total, p + flank), "_low_ejc": F.greatest(one, ejc - flank), "_high_ejc": F.least(total, ejc + flank)})
    regions = {
        "ptc_to_ejc": part("_cds", "coding_pos", "_ejc"), "newutr_all": F.concat(part("_cds", "coding_pos", "_total"), F.col("_utr")), "newutr_200": part("_cds", "coding_pos", "_to"), "ptc_pm100": part("_cds", "_low", "_high"),
        "ejc_pm100": part("_cds", "_low_ejc", "_high_ejc"), "utr3_all": F.col("_utr"), "utr3_200": part("_utr_spans", "_one", "_first"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("region"), v.alias("blocks")) for k, v in regions.items()]))
    return j.select("id", "chrom", "strand", each.alias("r")).select("id", "chrom", "strand", F.col("r.region").alias("region"), F.posexplode("r.blocks").alias("i", "b")).select("id", "region", "chrom", (F.col("i") + 1).alias("rank"), "b.start", "b.end", "strand")


def cds_interval_to_genomic(intervals: DataFrame, model: DataFrame) -> DataFrame:
    """CDS intervals (id, tx, from_, to_; 1-based) to genomic pieces (id, rank, start, end)."""
    j = intervals.join(model, "tx").withColumn("ends", cumulative_ends(F.col("cds")))
    x = j.select("id", "strand", "from_", "to_", "ends", F.posexplode("cds").alias("k", "b"))
    first = F.get("ends", F.col("k")) - (F.col("b.end") - F.col("b.start"))  # the block's first CDS position
    lo, hi = F.greatest(F.col("from_"), first), F.least(F.col("to_"), F.get("ends", F.col("k")))
    plus = F.col("strand") == "+"
    y = x.select("id", F.col("k").alias("rank"), F.when(plus, F.col("b.start") + lo - first).otherwise(F.col("b.end") - (hi - first)).alias("start"), F.when(plus, F.col("b.start") + hi - first).otherwise(F.col("b.end") - (lo - first)).alias("end"), lo.alias("lo"), hi.alias("hi"))
    return y.filter("lo <= hi").select("id", (F.col("rank") + 1).alias("rank"), "start", "end")


def splice_sequence(blocks: DataFrame, genome: DataFrame, chunk: int) -> DataFrame:
    """Blocks (tx, chrom, strand, rank, start, end) on a chunk table (chrom, chunk_no, seq) to ``tx, seq`` in transcript order.

    Each block is put together from the chunks that it touches and is reverse-complemented by itself on the minus strand.
    """
    need = blocks.withColumn("chunk_no", F.explode(F.sequence(F.floor((F.col("start") - 1) / chunk), F.floor((F.col("end") - 1) / chunk))))
    from_ = F.greatest(F.lit(1), F.col("start") - F.col("chunk_no") * chunk)
    to = F.least(F.lit(chunk), F.col("end") - F.col("chunk_no") * chunk)
    part = need.join(genome, ["chrom", "chunk_no"]).select("tx", "strand", "rank", "chunk_no", F.substring("seq", from_.cast("int"), (to - from_ + 1).cast("int")).alias("s"))
    glue = lambda *c: F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct(*c, "s"))), lambda x: x["s"]))
    whole = part.groupBy("tx", "strand", "rank").agg(glue("chunk_no").alias("s"))
    own = whole.withColumn("s", F.when(F.col("strand") == "-", revcomp(F.col("s"))).otherwise(F.col("s")))
    return own.groupBy("tx").agg(glue("rank").alias("seq"))
