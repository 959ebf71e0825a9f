"""Sinks: tables, VCF and annotator input, FASTA batches, audit reports. All write folders of part files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by: list[str] | None = None) -> None:
    """parquet, csv or tsv; csv and tsv with a header and NA for null."""
    w = df.write.mode("overwrite")
    w = w.partitionBy(*partition_by) if partition_by else w
    if form == "parquet":
        w.parquet(path)
    else:
        w.option("header", True).option("sep", "\t" if form == "tsv" else ",").option("nullValue", "NA").csv(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Saves a table in buckets of a key, a file for each, sorted by it, and reads it. Joins of such tables by the key, with as many buckets each, shuffle nothing."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def genome_part(chrom: Column, chunk_no: Column, span: int) -> Column:
    """The folder of a chunk."""
    return F.concat(chrom, F.lit("-"), F.floor(chunk_no / span).cast("string"))


def write_genome(chunks: DataFrame, path: str, span: int = 16) -> None:
    """Chunks (chrom, chunk_no, seq) as an indexed table: a folder for each ``span`` chunks of a sequence, which ``read_genome`` picks from."""
    parts = chunks.withColumn("part", genome_part(F.col("chrom"), F.col("chunk_no"), span))
    parts.repartition("part").sortWithinPartitions("part", "chunk_no").write.mode("overwrite").partitionBy("part").parquet(path)


def vcf_lines(df: DataFrame, passed: bool = True) -> DataFrame:
    """The eight VCF columns of variants, with '.' for ID, QUAL and INFO and PASS or '.' for FILTER."""
    dot = F.lit(".")
    return df.select(F.col("chrom").alias("#CHROM"), F.col("pos").alias("POS"), dot.alias("ID"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), dot.alias("QUAL"), F.lit("PASS" if passed else ".").alias("FILTER"), dot.alias("INFO"))


def write_vcf(df: DataFrame, path: str, passed: bool = True) -> None:
    # another comment sign: the writer would put the header's first name in quotes
    vcf_lines(df, passed).write.mode("overwrite").option("sep", "\t").option("header", True).option("comment", "\u0001").csv(path)


def write_avinput(df: DataFrame, path: str) -> None:
    """Five columns: chrom, start, end, ref, alt; the end covers the reference allele."""
    df.select("chrom", "pos", (F.col("pos") + F.length("ref") - 1).alias("end"), "ref", "alt").write.mode("overwrite").option("sep", "\t").csv(path)


def fasta_batches(df: DataFrame, size: int = 1000) -> DataFrame:
    """Records ``>seq_i`` of sequences (i, region, seq) with region and batch i // size; null and empty sequences are left out."""
    some = df.filter("seq IS NOT NULL AND seq <> ''")
    return some.select("region", F.floor(F.col("i") / size).alias("batch"), F.concat(F.lit(">seq_"), F.col("i").cast("string"), F.lit("\n"), F.col("seq")).alias("value"))


def write_fasta_batches(df: DataFrame, path: str, size: int = 1000) -> None:
    fasta_batches(df, size).repartition("region", "batch").write.mode("overwrite").partitionBy("region", "batch").text(path)


def write_audit_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
