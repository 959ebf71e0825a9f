"""Genomic-shaped frames from the given tables, and the same in DuckDB SQL as named subqueries.

Transcripts are orders, their exons its lines in a fixed order (length by quantity, introns of 150); variants, counts and
tracks are events; sequences are translated MD5 digests of the documents' texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ptclake.operators.ranks import dealt

_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem dealt by order, in parts that don't grow with the table; the windows below stay within them."""
    li = table(spark, sf_dir, "lineitem")
    return dealt(li, li.count(), "l_orderkey")


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx, chrom, strand, k (by position), start, end."""
    li = _lineitem(spark, sf_dir).select("l_orderkey", *_LINE)
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE)
    size = (F.col("l_quantity") * 6).cast("long") + 1
    before = F.coalesce(F.sum(size + 150).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = li.select(F.col("l_orderkey").alias("tx"), F.concat(F.lit("chr"), (F.col("l_orderkey") % 22 + 1).cast("string")).alias("chrom"), F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.row_number().over(w).alias("k"), (before + 100).alias("start"), size.alias("size"))
    return placed.select("tx", "chrom", "strand", "k", "start", (F.col("start") + F.col("size") - 1).alias("end"))


EXONS = f"""
_li AS (SELECT l_orderkey, CAST(floor(l_quantity * 6) AS BIGINT) + 1 AS size, row_number() OVER w AS k,
        coalesce(sum(CAST(floor(l_quantity * 6) AS BIGINT) + 151) OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE)})),
exons AS (SELECT l_orderkey AS tx, 'chr' || (l_orderkey % 22 + 1) AS chrom, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, k,
          CAST(before + 100 AS BIGINT) AS start, CAST(before + 100 + size - 1 AS BIGINT) AS "end" FROM _li)"""


def gene_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows (tx, gene, chrom, strand, feature, start, end): the CDS leaves out 20 bases at either end of the transcript."""
    e = exons(spark, sf_dir)
    w = Window.partitionBy("tx")
    lo, hi = F.min("start").over(w) + 20, F.max("end").over(w) - 20
    named = e.withColumn("gene", F.concat(F.lit("G"), (F.col("tx") % 500).cast("string"))).withColumn("lo", lo).withColumn("hi", hi)
    part = lambda feature, start, end: F.struct(F.lit(feature).alias("feature"), F.col(start).alias("start"), F.col(end).alias("end"))
    named = named.withColumns({"cds_start": F.greatest("start", "lo"), "cds_end": F.least("end", "hi")})
    both = named.select("tx", "gene", "chrom", "strand", F.explode(F.array(part("exon", "start", "end"), part("CDS", "cds_start", "cds_end"))).alias("p")).select("tx", "gene", "chrom", "strand", "p.*")
    return both.filter("feature = 'exon' OR start <= end")


MODEL = (
    EXONS
    + """,
_b AS (SELECT tx, min(start) + 20 AS lo, max("end") - 20 AS hi FROM exons GROUP BY tx),
cds AS (SELECT * FROM (SELECT e.tx, chrom, strand, k, greatest(start, lo) AS start, least("end", hi) AS "end" FROM exons e JOIN _b USING (tx)) WHERE start <= "end"),
cds5 AS (SELECT *, row_number() OVER (PARTITION BY tx ORDER BY CASE WHEN strand = '+' THEN start ELSE -"end" END) AS r FROM cds),
cdsx AS (SELECT *, "end" - start + 1 AS len, count(*) OVER (PARTITION BY tx) AS n,
         coalesce(sum("end" - start + 1) OVER (PARTITION BY tx ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum("end" - start + 1) OVER (PARTITION BY tx) AS total FROM cds5),
ex5 AS (SELECT *, row_number() OVER (PARTITION BY tx ORDER BY CASE WHEN strand = '+' THEN start ELSE -"end" END) AS r, count(*) OVER (PARTITION BY tx) AS n FROM exons)"""
)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tx, pos from events; a transcript has three of them, so both grow with the tables."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.expr("event_id div 3").alias("tx"), (100 + F.col("event_id") * 37 % 1100).alias("pos"))


VARIANTS = "variants AS (SELECT event_id AS id, event_id // 3 AS tx, 100 + event_id * 37 % 1100 AS pos FROM events)"

_SALTS = range(8)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq (256 bases) from documents; rows without text are left out."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    hexes = F.concat(*[F.md5(F.concat(F.col("text"), F.lit(str(k)))) for k in _SALTS])
    return d.select("doc_id", F.translate(hexes, "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


SEQUENCES = f"seqs AS (SELECT doc_id, translate({' || '.join(f"md5(text || '{k}')" for k in _SALTS)}, '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM documents WHERE text IS NOT NULL)"


#: A line's number within its order, in an order of all columns: an order and line number name several lines.
_ALL = [*_LINE, "l_returnflag", "l_linestatus"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with ``id``, a key of its own for each row."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ALL))
    return _lineitem(spark, sf_dir).withColumn("id", F.col("l_orderkey") * 1000 + number)


LINES = f"lines AS (SELECT *, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(f'{c} NULLS FIRST' for c in _ALL)}) AS id FROM lineitem)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, score, label and fold from lineitem: a score with many ties, a label that leans on it."""
    return lines(spark, sf_dir).select("id", (F.col("l_quantity") / 50).alias("score"), ((F.col("l_quantity") + F.col("l_tax") * 500 + F.col("l_partkey") % 37) > 60).cast("int").alias("label"), (F.col("l_orderkey") % 5).cast("int").alias("fold"), F.col("l_returnflag").alias("cohort"))


SCORES = f"{LINES}, scores AS (SELECT id, l_quantity / 50 AS score, CAST((l_quantity + l_tax * 500 + l_partkey % 37) > 60 AS INTEGER) AS label, CAST(l_orderkey % 5 AS INTEGER) AS fold, l_returnflag AS cohort FROM lines)"
