"""Readers with explicit schemas; delimited files go through Spark's CSV reader, split and read in parallel where not compressed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ptclake.sources.writers import genome_part

NULLS = ("NA", ".", "NaN")


def read_table(spark: SparkSession, path: str, schema: str | None = None, sep: str | None = None) -> DataFrame:
    """CSV or TSV with a header, gz or not; the separator by suffix, else by the first line. Strings without a schema; 'NA', '.', 'NaN' are null."""
    if sep is None:
        name = path.lower().removesuffix(".gz")
        sep = "\t" if name.endswith((".tsv", ".txt", ".bed")) else "," if name.endswith(".csv") else None
    if sep is None:
        first = spark.read.text(path).first()
        sep = "\t" if first and "\t" in first[0] else ","
    reader = spark.read.option("header", True).option("sep", sep)
    df = reader.schema(schema).option("nullValue", "NA").csv(path) if schema else reader.csv(path)
    return df.select([F.when(F.col(f"`{c}`").isin(*NULLS), None).otherwise(F.col(f"`{c}`")).alias(c) if k == "string" else F.col(f"`{c}`") for c, k in df.dtypes])


_GTF = "chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"


def gtf_attribute(name: str) -> Column:
    return F.nullif(F.regexp_extract("attributes", rf'(?:^|;\s*){name} "?([^";]*)"?', 1), F.lit(""))


def read_gtf(spark: SparkSession, path: str, features: tuple[str, ...] = ("exon", "CDS", "transcript", "stop_codon")) -> DataFrame:
    """GTF lines of the given features: tx, gene, gene_name, exon_number, tags, tsl, mane, appris beside the place."""
    raw = spark.read.schema(_GTF).option("sep", "\t").option("comment", "#").option("quote", "").csv(path).filter(F.col("feature").isin(*features))
    tags = F.regexp_extract_all("attributes", F.lit(r'tag "?([^";]+)"?'), F.lit(1))
    appris = F.array_min(F.transform(F.filter(tags, lambda t: t.startswith("appris_principal")), lambda t: F.regexp_extract(t, r"(\d+)$", 1).try_cast("int")))
    return raw.select(
        "chrom", "feature", "start", "end", "strand", gtf_attribute("transcript_id").alias("tx"), gtf_attribute("gene_id").alias("gene"), gtf_attribute("gene_name").alias("gene_name"), gtf_attribute("exon_number").try_cast("int").alias("exon_number"),
        tags.alias("tags"), F.regexp_extract(gtf_attribute("transcript_support_level"), r"^(\d+)", 1).try_cast("int").alias("tsl"), F.exists(tags, lambda t: t.startswith("MANE")).cast("int").alias("mane"), appris.alias("appris"),
    )


def read_annovar(spark: SparkSession, path: str, columns: int = 8) -> DataFrame:
    """Headerless exonic_variant_function: V1..Vn, and ``key`` from V4, V5, V7, V8."""
    schema = ", ".join(f"V{k} string" for k in range(1, columns + 1))
    df = spark.read.schema(schema).option("sep", "\t").csv(path)
    return df.withColumn("key", F.concat("V4", F.lit(":"), "V5", F.lit("_"), "V7", F.lit(">"), "V8"))


def read_intervals(spark: SparkSession, path: str, value: bool = False) -> DataFrame:
    """BED (or bedGraph with ``value``) as 1-based inclusive intervals; lines that don't end behind their start are dropped."""
    schema = "chrom string, start0 long, end0 long" + (", value double" if value else "")
    df = spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("enforceSchema", True).csv(path).filter("end0 > start0")
    return df.select("chrom", (F.col("start0") + 1).alias("start"), F.col("end0").alias("end"), *(["value"] if value else []))


def read_fasta(spark: SparkSession, path: str, chunk: int = 100_000) -> DataFrame:
    """Sequences as chunks (chrom, chunk_no, seq) of ``chunk`` bases, upper case; the name is the header's first word.

    Files are read by lines and split. A line's place in its sequence comes from running sums within its file's block, and from the blocks
    before it, a row each; so no row or task holds more than a block or a chunk. A name's sequences in several places follow one another.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    header = F.col("value").startswith(">")
    name = F.when(header, F.regexp_extract("value", r"^>\s*(\S*)", 1))
    rows = lines.select("file", "block", "line", name.alias("name"), F.when(header, "").otherwise(F.upper(F.regexp_replace("value", r"\s+", ""))).alias("seq"))
    upto = Window.partitionBy("file", "block").orderBy("line")
    run = rows.withColumn("chrom", F.last("name", ignorenulls=True).over(upto)).withColumn("bases", F.sum(F.length("seq")).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    # per block: its last header; a block that begins within a sequence goes on with the one before
    blocks = run.groupBy("file", "block").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("line"))).alias("last"), F.max("bases").alias("bases"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"), F.coalesce(F.sum("bases").over(earlier), F.lit(0)).alias("before"))
    placed = run.join(blocks, ["file", "block"]).select("file", F.coalesce("chrom", "carried").alias("chrom"), "name", "seq", (F.col("bases") + F.col("before") - F.length("seq")).alias("at"))
    first = placed.filter("name IS NOT NULL").groupBy("file", "chrom").agg(F.min("at").alias("first"))
    bases = placed.filter("seq <> ''").join(first, ["file", "chrom"]).select("chrom", "seq", (F.col("at") - F.col("first")).alias("at"))
    k = F.explode(F.sequence(F.floor(F.col("at") / chunk), F.floor((F.col("at") + F.length("seq") - 1) / chunk)))
    pieces = bases.select("chrom", "seq", "at", k.alias("chunk_no"))
    low, high = F.greatest(F.lit(0), F.col("chunk_no") * chunk - F.col("at")), F.least(F.length("seq"), (F.col("chunk_no") + 1) * chunk - F.col("at"))
    part = F.substring("seq", (low + 1).cast("int"), (high - low).cast("int"))
    glued = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("at", part.alias("s")))), lambda x: x["s"]))  # a chunk's lines
    return pieces.groupBy("chrom", "chunk_no").agg(glued.alias("seq")).select("chrom", F.col("chunk_no").cast("long").alias("chunk_no"), "seq")


def read_genome(spark: SparkSession, path: str, ranges: DataFrame, chunk: int = 100_000, span: int = 16) -> DataFrame:
    """The chunks (chrom, chunk_no, seq) of a table by ``write_genome`` that 1-based ranges (chrom, start, end) touch.

    Only folders with a wanted chunk are read: while the wanted ones are few enough to go to all tasks, Spark prunes the folders by them as the query
    runs. Ranges that end before they start touch none. ``chunk`` and ``span`` are those of the table.
    """
    each = F.explode(F.sequence(F.floor((F.col("start") - 1) / chunk), F.floor((F.col("end") - 1) / chunk)))
    wanted = ranges.filter((F.col("start") <= F.col("end")) & (F.col("start") >= 1)).select("chrom", each.alias("chunk_no")).distinct().withColumn("part", genome_part(F.col("chrom"), F.col("chunk_no"), span))
    table = spark.read.schema("chrom string, chunk_no long, seq string, part string").parquet(path)
    return table.join(wanted, ["part", "chrom", "chunk_no"], "left_semi").select("chrom", "chunk_no", "seq")


def read_vcf_sites(spark: SparkSession, path: str) -> DataFrame:
    """The eight fixed VCF columns, and ``ann``, the ANN field of INFO."""
    schema = "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string"
    df = spark.read.schema(schema).option("sep", "\t").option("comment", "#").csv(path)
    return df.withColumn("ann", F.nullif(F.regexp_extract("info", r"(?:^|;)ANN=([^;]*)", 1), F.lit("")))


#: Calls without an alternative allele, or without a call.
REFERENCE_CALLS = ("0/0", "0|0", "0", "./.", ".|.", ".")


def read_genotypes(spark: SparkSession, path: str, sep: str = "\t", sites: DataFrame | None = None, drop: tuple[str, ...] = (), fixed: int = 2) -> DataFrame:
    """A wide table (chrom, pos, ``fixed`` leading columns in all, then a column per sample) as rows sample, chrom, pos, gt.

    The header is read once, and a line is one array of calls by position: neither the plan nor the schema follows the number of samples. Calls
    in ``drop`` (see REFERENCE_CALLS) go and lines are joined to ``sites(chrom, pos)`` while they are arrays, so only what is left becomes
    rows. With nine fixed columns the file is a VCF: its ``##`` lines are skipped and a call ends at its first colon. Empty calls
    are null and stay unless ``drop`` holds ''; files of one path have one header.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("##") & (F.col("value") != ""))
    header = lines.first()
    if header is None:
        return spark.createDataFrame([], "sample string, chrom string, pos long, gt string")
    quoted = "\\Q" + sep + "\\E"
    fields = F.split("value", quoted, -1)
    # the header's own array is a constant of the plan
    names = F.slice(F.split(F.lit(header[0]), quoted, -1), fixed + 1, header[0].count(sep) + 1)
    calls = F.slice(fields, fixed + 1, F.size(fields))
    if fixed == 9:
        calls = F.transform(calls, lambda x: F.substring_index(x, ":", 1))
    numbered = F.transform(calls, lambda x, k: F.struct(k.alias("k"), x.alias("gt")))
    kept = F.filter(numbered, lambda c: ~c["gt"].isin(*drop)) if drop else numbered
    arrays = lines.filter(F.col("value") != header[0]).select(fields[0].alias("chrom"), fields[1].try_cast("long").alias("pos"), kept.alias("calls"))
    if sites is not None:
        arrays = arrays.join(sites.select("chrom", "pos"), ["chrom", "pos"], "left_semi")
    rows = arrays.select("chrom", "pos", F.explode("calls").alias("c"))
    return rows.select(F.get(names, F.col("c.k")).alias("sample"), "chrom", "pos", F.nullif("c.gt", F.lit("")).alias("gt"))


def genotypes_long(wide: DataFrame, ids: tuple[str, ...] = ("chrom", "pos")) -> DataFrame:
    """The same from a wide frame with few sample columns."""
    samples = [c for c in wide.columns if c not in ids]
    return wide.unpivot(list(ids), samples, "sample", "gt")


def read_gene_table(spark: SparkSession, path: str, gene: str, values: list[str]) -> DataFrame:
    """Expression, half-life, constraint or eGene tables: ``gene_id`` (versions dropped) and values as doubles."""
    from ptclake.functions.variants import coerce_numeric, strip_version

    df = read_table(spark, path)
    return df.select(strip_version(F.col(f"`{gene}`")).alias("gene_id"), *[coerce_numeric(F.col(f"`{c}`")).alias(c) for c in values])
