"""Queries over files: each writes a format from the given tables by a sink, or as lines, and reads it by its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ptclake.operators import evaluation as E
from ptclake.operators import features as X
from ptclake.plans.queries import query
from ptclake.plans.shapes import LINES, MODEL, SEQUENCES, gene_model, lines, sequences, table
from ptclake.sources import readers as R
from ptclake.sources import writers as W
from ptclake.sources.scratch import scratch_path


def _text(rows: DataFrame, name: str, *columns: str, header: list[str] | None = None) -> str:
    """Writes tab-separated lines, gzipped, behind a file of the header, and gives the path."""
    path = scratch_path(rows.sparkSession, name)
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value")
    out = rows.select(line)
    if header:
        out = rows.sparkSession.createDataFrame([("\t".join(header),)], "value string").unionAll(out)
    out.write.option("compression", "gzip").text(path)
    return path


_CALLS = "CASE (o_orderkey * 7 + {k} * 13) % 11 WHEN 0 THEN '0/1' WHEN 1 THEN '1|1' WHEN 2 THEN './.' WHEN 3 THEN '' ELSE '0/0' END"
_SAMPLES = [f"s{k}" for k in range(24)]


@query(
    f"""WITH w AS (SELECT 'chr' || (o_custkey % 5) AS chrom, o_orderkey AS pos, unnest([{", ".join(_CALLS.format(k=k) for k in range(24))}]) AS gt, unnest([{", ".join(f"'{s}'" for s in _SAMPLES)}]) AS sample FROM orders),
s AS (SELECT DISTINCT 'chr' || (o_custkey % 5) AS chrom, o_orderkey AS pos FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_discount > 0.05)
SELECT sample, chrom, pos, gt FROM w SEMI JOIN s USING (chrom, pos) WHERE gt NOT IN ('0/0', './.', '')"""
)
def genotype_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alternative calls of a wide genotype file at wanted sites."""
    orders = table(spark, sf_dir, "orders").selectExpr("concat('chr', o_custkey % 5) AS chrom", "o_orderkey", *[f"{_CALLS.format(k=k)} AS {s}" for k, s in enumerate(_SAMPLES)])
    path = scratch_path(spark, "genotypes")
    orders.withColumnRenamed("o_orderkey", "pos").write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
    hit = table(spark, sf_dir, "lineitem").filter("l_discount > 0.05").select(F.col("l_orderkey").alias("pos")).distinct()
    sites = orders.select("chrom", F.col("o_orderkey").alias("pos")).join(hit, "pos").select("chrom", "pos")
    return R.read_genotypes(spark, path, sites=sites, drop=(*R.REFERENCE_CALLS, ""))


@query("SELECT 'chr' || (p_size % 22) AS chrom, p_partkey AS pos, substr('ACGT', CAST(p_partkey % 4 + 1 AS INTEGER), 1) AS ref, CASE WHEN p_size % 9 = 0 THEN 'AT' ELSE substr('ACGT', CAST((p_partkey + 1) % 4 + 1 AS INTEGER), 1) END AS alt, 'PASS' AS filter, CAST(NULL AS VARCHAR) AS ann FROM part")
def vcf_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants written as a VCF and read again."""
    path = scratch_path(spark, "vcf")
    W.write_vcf(table(spark, sf_dir, "part").selectExpr("concat('chr', p_size % 22) AS chrom", "p_partkey AS pos", "substring('ACGT', cast(p_partkey % 4 + 1 AS int), 1) AS ref", "CASE WHEN p_size % 9 = 0 THEN 'AT' ELSE substring('ACGT', cast((p_partkey + 1) % 4 + 1 AS int), 1) END AS alt"), path)
    return R.read_vcf_sites(spark, path).select("chrom", "pos", "ref", "alt", "filter", "ann")


@query("SELECT 'chr' || (event_id % 22) AS chrom, event_id AS pos, 'T|stop_gained|' || user_id AS ann FROM events")
def vcf_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ANN fields of VCF lines."""
    e = table(spark, sf_dir, "events").selectExpr("concat('chr', event_id % 22) AS chrom", "event_id AS pos", "'.' AS id", "'A' AS ref", "'T' AS alt", "concat('DP=7;ANN=T|stop_gained|', user_id, ';AF=0.1') AS info")
    path = _text(e, "vcf-lines", "chrom", "pos", "id", "ref", "alt", "id", "id", "info", header=["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"])
    return R.read_vcf_sites(spark, path).select("chrom", "pos", "ann")


@query("SELECT CAST(p_size AS VARCHAR) AS chrom, p_partkey AS start, p_partkey + length(p_brand) - 1 AS \"end\", p_brand AS ref, '-' AS alt FROM part")
def annotator_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants written as an annotator's input."""
    path = scratch_path(spark, "avinput")
    W.write_avinput(table(spark, sf_dir, "part").selectExpr("cast(p_size AS string) AS chrom", "p_partkey AS pos", "p_brand AS ref", "'-' AS alt"), path)
    return spark.read.schema("chrom string, start long, end long, ref string, alt string").option("sep", "\t").csv(path)


@query(f"WITH {SEQUENCES}, k AS (SELECT *, unnest(range(3)) AS c FROM seqs) SELECT 'seq_' || doc_id AS chrom, CAST(c AS BIGINT) AS chunk_no, substr(seq, CAST(100 * c + 1 AS INTEGER), 100) AS seq FROM k")
def fasta_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences written as FASTA batches and read in chunks."""
    path = scratch_path(spark, "fasta")
    W.write_fasta_batches(sequences(spark, sf_dir).select(F.col("doc_id").alias("i"), F.lit("utr3").alias("region"), "seq"), path, size=100)
    return R.read_fasta(spark, path, chunk=100)


@query(
    f"""WITH {MODEL}, f AS (SELECT tx, chrom, strand, 'exon' AS feature, start, "end", k FROM exons UNION ALL SELECT tx, chrom, strand, 'CDS', start, "end", k FROM cds)
SELECT 'T' || tx || '.1' AS tx, 'G' || (tx % 500) AS gene, chrom, feature, start, "end", strand, CASE WHEN tx % 3 = 0 THEN 1 ELSE 0 END AS mane, CASE WHEN tx % 4 = 1 THEN CAST(tx % 5 + 1 AS INTEGER) END AS tsl FROM f"""
)
def gtf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons and coding parts of a GTF, with the tags of their transcripts."""
    m = gene_model(spark, sf_dir)
    marks = F.concat(F.lit('gene_id "'), "gene", F.lit('"; transcript_id "T'), F.col("tx").cast("string"), F.lit('.1"; '), F.when(F.col("tx") % 3 == 0, 'tag "basic"; tag "MANE_Select"; ').otherwise(""), F.when(F.col("tx") % 4 == 1, F.concat(F.lit('transcript_support_level "'), (F.col("tx") % 5 + 1).cast("string"), F.lit('";'))).otherwise(""))
    path = _text(m.withColumns({"source": F.lit("x"), "dot": F.lit("."), "marks": marks}), "gtf", "chrom", "source", "feature", "start", "end", "dot", "strand", "dot", "marks")
    return R.read_gtf(spark, path).select("tx", "gene", "chrom", "feature", "start", "end", "strand", "mane", "tsl")


@query("SELECT event_id AS id, 'chr' || (event_id % 22) || ':' || event_id || '_A>T' AS key FROM events")
def annotator_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of an annotator's output lines."""
    e = table(spark, sf_dir, "events").selectExpr("event_id AS id", "'stopgain' AS kind", "concat('chr', event_id % 22) AS chrom", "'A' AS ref", "'T' AS alt")
    return R.read_annovar(spark, _text(e, "annotator", "id", "kind", "kind", "chrom", "id", "id", "ref", "alt")).select(F.col("V1").cast("long").alias("id"), "key")


@query("SELECT 'chr' || (event_id % 22) AS chrom, event_id * 10 + 1 AS start, event_id * 10 + user_id % 7 AS \"end\", round(value, 6) AS value FROM events WHERE user_id % 7 > 0")
def track_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a bedGraph as 1-based intervals; empty ones go."""
    e = table(spark, sf_dir, "events").selectExpr("concat('chr', event_id % 22) AS chrom", "event_id * 10 AS a", "event_id * 10 + user_id % 7 AS b", "value")
    return R.read_intervals(spark, _text(e, "track", "chrom", "a", "b", "value"), value=True).withColumn("value", F.round("value", 6))


@query("SELECT 'G' || c_custkey AS gene_id, CASE WHEN c_custkey % 4 > 0 THEN round(c_acctbal, 4) END AS bal, CAST(c_nationkey AS DOUBLE) AS nation FROM customer")
def gene_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gene table written as CSV and read by gene."""
    path = scratch_path(spark, "genes") + ".csv"
    W.write_table(table(spark, sf_dir, "customer").selectExpr("concat('G', c_custkey, '.', c_nationkey + 1) AS Name", "CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS bal", "c_nationkey AS nation"), path, "csv")
    return R.read_gene_table(spark, path, "Name", ["bal", "nation"]).withColumn("bal", F.round("bal", 4))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS seg, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name FROM customer")
def delimited_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as TSV and read as strings."""
    path = scratch_path(spark, "table") + ".tsv"
    W.write_table(table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS seg", "CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name"), path, "tsv")
    return R.read_table(spark, path)


@query("SELECT unnest(['c_acctbal', 'gone', 'c_custkey']) AS feature, unnest(['present', 'missing', 'extra']) AS status, unnest([count(*) - count(c_acctbal), count(*), count(*) - count(c_custkey)]) AS n_null FROM customer")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit written as JSON."""
    path = scratch_path(spark, "audit")
    W.write_audit_json(X.audit_columns(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "gone"]), path)
    return spark.read.schema("feature string, status string, n_null long").json(path)


@query("SELECT l_returnflag, l_discount, count(*) AS ties, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) * 0 + coalesce(sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_discount ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (count(*) + 1) / 2 AS rank FROM lineitem GROUP BY 1, 2")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average ranks of tied values within groups."""
    return E.rank_with_ties(table(spark, sf_dir, "lineitem"), "l_discount", ["l_returnflag"])


@query(f"WITH {LINES} SELECT id, l_extendedprice, l_quantity FROM lines")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two columns with the largest means, resolved by their first names that are there, beside the id."""
    li = lines(spark, sf_dir).select("id", "l_quantity", "l_tax", "l_extendedprice", "l_discount")
    names = X.resolve_columns(li, {"price": ["price", "l_extendedprice"], "quantity": ["l_quantity", "quantity"], "tax": ["tax", "l_tax"]})
    ranking = X.feature_profile(li, list(names.values())).select("feature", F.col("mean").alias("importance"))
    return X.select_top_features(li, ranking, 2, ["id"])


@query("SELECT unnest(['flag', 'half', 'kind']) AS feature")
def categorical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that are categories: declared, of 0 and 1 only, or strings."""
    li = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS flag", "cast(l_quantity > 25 AS int) AS half", "l_linenumber AS number", "l_tax AS tax", "l_suppkey % 3 AS kind")
    return spark.createDataFrame([(c,) for c in X.categorical_columns(li, ["kind"])], "feature string")
