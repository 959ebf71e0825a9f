"""Cohort operators: consequence and quality filters, joins of annotation, genotype and counts, labels from allele ratios, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ptclake.functions.variants import coerce_bool, label_escape, parse_annotations, split_txnames, strip_version
from ptclake.operators.ranks import numbered, range_number, value_cuts


def filter_consequence(sites: DataFrame, column: str = "ann", stopgain_only: bool = False) -> DataFrame:
    """Sites whose annotation names a frameshift or a stop gain; with ``stopgain_only`` the latter alone."""
    return sites.filter(F.col(column).rlike("stop_?gain" if stopgain_only else "frameshift_variant|stop_gained"))


def filter_snv(df: DataFrame) -> DataFrame:
    return df.filter((F.length("ref") == 1) & (F.length("alt") == 1))


def filter_defined_alt(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("alt").contains("N"))


def filter_ptc(df: DataFrame, column: str = "is_ptc") -> DataFrame:
    """Rows marked as premature stops; a mark that isn't true in any spelling is none."""
    return df.filter(F.coalesce(coerce_bool(F.col(column)), F.lit(False)))


def filter_het(df: DataFrame) -> DataFrame:
    """Genotype 0/1."""
    return df.filter(F.col("gt") == "0/1")


def filter_min_depth(df: DataFrame, depth: int = 8) -> DataFrame:
    return df.filter(F.col("totalCount") >= depth)


def explode_txnames(df: DataFrame, column: str = "txnames") -> DataFrame:
    """A row per transcript, versions dropped, in ``tx``; rows without one keep a null."""
    return df.withColumn("tx", F.explode_outer(split_txnames(F.col(column))))


def first_txname(column: str = "txnames") -> Column:
    return F.get(split_txnames(F.col(column)), F.lit(0))


def join_annotation_genotype(annotation: DataFrame, genotype: DataFrame) -> DataFrame:
    """Inner join by ``key``."""
    return annotation.join(genotype, "key")


def join_ase_genotype(ase: DataFrame, genotype: DataFrame, metadata: DataFrame) -> DataFrame:
    """Counts (run, chrom, pos, ...) and genotypes (sample, chrom, pos, gt) by way of the runs' samples."""
    return ase.join(metadata, "run").join(genotype, ["sample", "chrom", "pos"])


def canonical_by_gene(variants: DataFrame, canonical: DataFrame) -> DataFrame:
    """Variants (with ``v3``) whose annotation lists the canonical transcript (gene, canonical_tx) of one of its genes; a row per such gene."""
    parsed = variants.withColumn("a", F.explode(parse_annotations(F.col("v3"))))
    hit = parsed.join(canonical, (F.col("a.gene") == canonical["gene"]) & (F.col("a.tx") == strip_version(canonical["canonical_tx"])))
    return hit.select(*variants.columns, canonical["gene"], "canonical_tx", F.col("a.coding_pos").alias("coding_pos"))


def strict_tx_match(variants: DataFrame, contexts: DataFrame) -> DataFrame:
    """Per variant (id, txnames, v3) the first transcript in txnames order that v3 lists too and that has a context (id, tx, context)."""
    listed = variants.withColumn("_v", parse_annotations(F.col("v3"))).select("id", F.posexplode(split_txnames(F.col("txnames"))).alias("i", "tx"), F.col("_v.tx").alias("in_v3"))
    ok = listed.filter(F.array_contains("in_v3", F.col("tx"))).join(contexts.filter("context IS NOT NULL"), ["id", "tx"])
    return ok.groupBy("id").agg(F.min(F.struct("i", "tx", "context")).alias("m")).select("id", "m.tx", "m.context")


def anti_filters(variants: DataFrame, single_exon_genes: DataFrame | None = None, low_expression: DataFrame | None = None, eqtl: DataFrame | None = None, imprinted: DataFrame | None = None, indels: DataFrame | None = None, least: float = 1.0, q: float = 0.05) -> DataFrame:
    """Removes variants of single-exon, lowly expressed (value <= ``least``) and imprinted genes, significant eQTL variants (ids end in ``_b38``), and indels."""
    out = variants
    for genes in (single_exon_genes, imprinted):
        if genes is not None:
            out = out.join(genes.select(strip_version(F.col("gene_id")).alias("_g")).distinct(), strip_version(F.col("gene_id")) == F.col("_g"), "left_anti")
    if low_expression is not None:
        low = low_expression.filter(F.col("value") <= least).select(strip_version(F.col("gene_id")).alias("_g"))
        out = out.join(low, strip_version(F.col("gene_id")) == F.col("_g"), "left_anti")
    if eqtl is not None:
        hit = eqtl.filter(F.col("qval") <= q).select(F.regexp_replace("variant_id", "_b38$", "").alias("_v"))
        out = out.join(hit, F.col("variant_id") == F.col("_v"), "left_anti")
    return out if indels is None else out.join(indels.select("variant_id"), "variant_id", "left_anti")


def common_variants(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def missing_keys(all_keys: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Keys without a result."""
    return all_keys.select(key).distinct().join(results.select(key), key, "left_anti")


def union_cohorts(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def one_per_key(df: DataFrame, key: str, salt: str = "") -> DataFrame:
    """One row per key: the one with the least MD5 of its columns; partial aggregation, so a hot key doesn't meet in one task."""
    mark = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns], F.lit(salt)))
    return df.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*df.columns), mark).alias("r")).select("r.*")


def variant_frequency(df: DataFrame, key: str = "key") -> DataFrame:
    """Rows per key; one is ultra-rare, more are rare-common."""
    return df.groupBy(key).agg(F.count("*").alias("freq")).withColumn("freq_cat", F.when(F.col("freq") == 1, "ultra-rare").otherwise("rare-common"))


def ase_resample(counts: DataFrame, draws: int = 100) -> DataFrame:
    """Per key (key, read_id, refCount, totalCount): the median over draws of the ratio refCount/totalCount of one read row each.

    Draw t takes the row at ``hash(key, t) mod n`` in the order of read_id, a number. Rows of a key are sorted by ranges of read_id. Draws are made per key and joined back by (key, index),
    so nothing is multiplied before it is aggregated; one row's key uses its own ratio.
    """
    placed = numbered(counts, ["key"], ["read_id"], range_number(F.col("read_id"), value_cuts(counts, "read_id")), "i")
    n = counts.groupBy("key").agg(F.count("*").alias("n"))
    pick = F.conv(F.substring(F.md5(F.concat(F.col("key").cast("string"), F.lit(":"), F.col("t").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n")
    drawn = n.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select("key", pick.alias("i")).groupBy("key", "i").agg(F.count("*").alias("times"))
    hit = drawn.join(placed, ["key", "i"]).withColumn("ratio", F.when(F.col("totalCount") > 0, F.col("refCount") / F.col("totalCount")))
    return hit.groupBy("key").agg(F.expr("percentile(ratio, 0.5, times)").alias("ratio"), F.max("i").isNotNull().alias("seen")).drop("seen").withColumn("escape", label_escape(F.col("ratio")))
