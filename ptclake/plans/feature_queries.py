"""More registered queries: joins of annotation tables, regions, sequences, audits and summaries. Holds the whole registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ptclake.functions import sequence as S
from ptclake.functions import variants as V
from ptclake.operators import cohorts as C
from ptclake.operators import correlation as K
from ptclake.operators import evaluation as E
from ptclake.operators import features as X
from ptclake.operators import motifs as M
from ptclake.operators import transcripts as T
from ptclake.plans.queries import ORACLES, QUERIES, _round, query
from ptclake.plans.shapes import EXONS, MODEL, SCORES, SEQUENCES, VARIANTS, exons, gene_model, scores, sequences, table, variants

__all__ = ["ORACLES", "QUERIES"]


@query(
    f"""WITH {MODEL}, v AS (SELECT event_id AS id, event_id // 3 AS tx, event_id * 31 % 1500 + 1 AS pos FROM events),
x AS (SELECT v.id, v.pos, c.r, c.n, c.before + c.len AS e, c.before + 1 AS s, c.total, row_number() OVER (PARTITION BY v.id ORDER BY c.r) AS k FROM v JOIN cdsx c ON v.tx = c.tx AND c.before + c.len >= v.pos)
SELECT id, CAST(r AS INTEGER) AS mut_exon, CAST(n AS INTEGER) AS exon_count, CAST(e - s + 1 AS BIGINT) AS exon_length, CAST(pos - s AS BIGINT) AS to_exon_start, CAST(e - pos AS BIGINT) AS to_exon_end, CAST(total - pos AS BIGINT) AS to_end, round(pos / total, 8) AS relative,
CAST(n - r AS INTEGER) AS exons_after, r = n AS last_exon, CASE WHEN n > 1 THEN r = n END AS last_exon_strict, e - s + 1 >= 400 AS long_exon, n = r + 1 AND e - 50 <= pos AND e - s + 1 >= 50 AS penultimate_last50 FROM x WHERE k = 1"""
)
def exon_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mutated exon of each coding position and its distances."""
    ends = T.exon_counts(T.transcript_model(gene_model(spark, sf_dir))).select("tx", "cds_exon_ends")
    v = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr("event_id div 3").alias("tx"), (F.col("event_id") * 31 % 1500 + 1).alias("pos"))
    d = v.join(ends, "tx").select("id", V.ptc_distances(F.col("pos"), F.col("cds_exon_ends")).alias("d")).select("id", "d.*").filter("mut_exon IS NOT NULL")
    long = ("exon_length", "to_exon_start", "to_exon_end", "to_end")
    return _round(d.select("id", "mut_exon", "exon_count", *[F.col(c).cast("long").alias(c) for c in long], "relative", "exons_after", "last_exon", "last_exon_strict", "long_exon", "penultimate_last50"))


@query(
    """WITH a AS (SELECT event_id, user_id AS run, 'chr' || (event_id % 5) AS chrom, event_id AS pos, value FROM events), m AS (SELECT DISTINCT user_id AS run, 's' || (user_id % 4) AS sample FROM events),
g AS (SELECT DISTINCT 's' || (user_id % 4) AS sample, 'chr' || (event_id % 5) AS chrom, event_id * 3 AS pos, CASE WHEN (event_id + user_id) % 2 = 0 THEN '0/1' ELSE '1/1' END AS gt FROM events)
SELECT event_id, a.chrom, a.pos, sample FROM a JOIN m USING (run) JOIN g USING (sample, chrom, pos) WHERE gt = '0/1'"""
)
def heterozygous_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts joined with genotypes by way of samples, heterozygous only."""
    e = table(spark, sf_dir, "events")
    ase = e.selectExpr("event_id", "user_id AS run", "concat('chr', event_id % 5) AS chrom", "event_id AS pos", "value")
    meta = e.selectExpr("user_id AS run", "concat('s', user_id % 4) AS sample").distinct()
    gt = e.selectExpr("concat('s', user_id % 4) AS sample", "concat('chr', event_id % 5) AS chrom", "event_id * 3 AS pos", "CASE WHEN (event_id + user_id) % 2 = 0 THEN '0/1' ELSE '1/1' END AS gt").distinct()
    return C.join_ase_genotype(ase, C.filter_het(gt), meta).select("event_id", "chrom", "pos", "sample")


_V3 = "concat('G', user_id, ':T', event_id div 3, '.2:exon1:c.C', event_id % 700 + 1, 'T:p.R9X,G', user_id + 1, ':T', event_id div 4, '.1:exon2:c.G5A:p.W2X')"


@query(
    """WITH p AS (SELECT event_id AS id, unnest([user_id, user_id + 1]) AS g, unnest([event_id // 3, event_id // 4]) AS t, unnest([event_id % 700 + 1, 5]) AS pos FROM events), c AS (SELECT user_id AS g, min(event_id) // 3 AS t FROM events GROUP BY 1)
SELECT id, 'G' || p.g AS gene, 'T' || c.t || '.5' AS canonical_tx, pos AS coding_pos FROM p JOIN c ON p.g = c.g AND p.t = c.t"""
)
def canonical_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants whose annotation lists the canonical transcript of its gene."""
    v = table(spark, sf_dir, "events").selectExpr("event_id AS id", f"{_V3} AS v3")
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("e")).selectExpr("concat('G', user_id) AS gene", "concat('T', e div 3, '.5') AS canonical_tx")
    return C.canonical_by_gene(v, c).drop("v3")


@query(
    """WITH n AS (SELECT event_id AS id, unnest([1, 2, 3]) AS i, unnest([user_id, event_id // 4, event_id // 3]) AS t FROM events), ok AS (SELECT n.* FROM n JOIN events e ON e.event_id = n.id AND (n.t = e.event_id // 3 OR n.t = e.event_id // 4) WHERE n.t % 3 <> 0)
SELECT id, 'T' || arg_min(t, i) AS tx, 'ctx' || arg_min(t, i) AS context FROM ok GROUP BY id"""
)
def matched_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first named transcript that the annotation lists and that has a context."""
    v = table(spark, sf_dir, "events").selectExpr("event_id AS id", "concat('T', user_id, '.1;T', event_id div 4, ',T', event_id div 3) AS txnames", f"{_V3} AS v3")
    ctx = C.explode_txnames(v).select("id", "tx").distinct().withColumn("context", F.when(F.substring("tx", 2, 9).cast("int") % 3 != 0, F.concat(F.lit("ctx"), F.substring("tx", 2, 9))))
    return C.strict_tx_match(v, ctx)


@query("SELECT c_custkey, c_acctbal AS a, c_acctbal * 2 AS b FROM customer WHERE c_custkey % 3 <> 0")
def paired_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two score tables joined one to one."""
    c = table(spark, sf_dir, "customer")
    return X.join_predictions(c.select("c_custkey", F.col("c_acctbal").alias("a")), c.filter("c_custkey % 3 <> 0").select("c_custkey", (F.col("c_acctbal") * 2).alias("b")), "c_custkey")


@query(
    f"""WITH {EXONS}, t AS (SELECT DISTINCT tx FROM exons WHERE tx % 6 = 1), v AS (SELECT event_id AS id, event_id // 3 AS tx FROM events),
f AS (SELECT tx, count(*) AS n_exons, sum("end" - start + 1) AS len, max("end") AS last FROM exons GROUP BY tx)
SELECT v.id, v.tx, f.n_exons, CAST(f.len AS BIGINT) AS len, CASE WHEN v.tx % 2 = 0 THEN f.last END AS last, CASE WHEN f.tx IS NULL THEN NULL WHEN t.tx IS NULL THEN 'no' ELSE 'yes' END AS intron FROM v LEFT JOIN f USING (tx) LEFT JOIN t USING (tx)"""
)
def transcript_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CDS and UTR tables and flags put on transcripts, then on variants."""
    e = exons(spark, sf_dir)
    g = e.groupBy("tx").agg(F.count("*").alias("n_exons"), F.sum(F.col("end") - F.col("start") + 1).alias("len"), F.max("end").alias("last"))
    v = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr("event_id div 3").alias("tx"))
    return X.attach_transcript_features(v, g.select("tx", "n_exons"), g.select("tx", "len"), g.filter("tx % 2 = 0").select("tx", "last"), {"intron": e.filter("tx % 6 = 1")})


@query(f"WITH {EXONS} SELECT DISTINCT 'T' || tx AS tx, 'G' || (tx % 500) AS gene FROM exons WHERE tx IN (SELECT event_id // 3 FROM events)")
def transcript_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript-gene pairs of the transcripts that variants name."""
    f = exons(spark, sf_dir).select(F.concat(F.lit("T"), F.col("tx"), F.lit(".3")).alias("tx"), F.concat(F.lit("G"), F.col("tx") % 500, F.lit(".1")).alias("gene"))
    return X.tx_to_gene(f, table(spark, sf_dir, "events").select(F.concat(F.lit("T"), F.expr("event_id div 3")).alias("tx")))


_SPARSE = "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS seg, c_nationkey FROM customer"


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS bal", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS seg", "c_nationkey")


@query(
    f"""WITH c AS ({_SPARSE}), n AS (SELECT count(*) AS n, count(bal) AS b, count(seg) AS s FROM c)
SELECT 'bal' AS feature, 'present' AS status, n - b AS n_null FROM n UNION ALL SELECT 'seg', 'present', n - s FROM n UNION ALL SELECT 'gone', 'missing', n FROM n UNION ALL SELECT 'c_custkey', 'extra', 0 FROM n UNION ALL SELECT 'c_nationkey', 'extra', 0 FROM n"""
)
def column_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present, missing and extra columns against a model's list, with their nulls."""
    return X.audit_columns(_sparse(spark, sf_dir), ["bal", "seg", "gone"])


@query(f"WITH c AS ({_SPARSE}) SELECT 'bal' AS feature, count(bal) AS n, round(100 * count(bal) / count(*), 2) AS pct FROM c UNION ALL SELECT 'seg', count(seg), round(100 * count(seg) / count(*), 2) FROM c")
def column_match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.match_rates(_sparse(spark, sf_dir), ["bal", "seg"])


@query(
    """WITH l AS (SELECT l_quantity AS a, l_quantity * 2 + l_tax AS b, l_discount AS c FROM lineitem) SELECT 'a' AS x, 'b' AS y, round(corr(a, b), 6) AS r FROM l UNION ALL SELECT 'a', 'c', round(corr(a, c), 6) FROM l UNION ALL SELECT 'b', 'c', round(corr(b, c), 6) FROM l"""
)
def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise correlations, as the pruning sees them."""
    c = K.correlations(table(spark, sf_dir, "lineitem").selectExpr("l_quantity AS a", "l_quantity * 2 + l_tax AS b", "l_discount AS c"), ["a", "b", "c"])
    return c.select(F.col("a").alias("x"), F.col("b").alias("y"), F.round("correlation", 6).alias("r"))


#: Eighteen columns, two of them near copies and one constant, with nulls at rows of their own.
_WIDE = {
    f"f{k:02}": f"CASE WHEN (l_partkey + {k} * l_suppkey) % {k + 4} <> 0 THEN CAST({x} AS DOUBLE) END"
    for k, x in enumerate(["l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity * 3 + l_tax", "l_extendedprice + 1000000", "l_quantity * l_discount", "l_partkey % 17", "l_suppkey % 5", "7", "l_orderkey", "l_orderkey % 100", "l_extendedprice * (1 - l_discount)", "l_quantity - l_linenumber", "l_tax * l_tax"])
}
_WIDE_PAIRS = [(a, b) for a in _WIDE for b in _WIDE if a < b]


@query(
    f"""WITH l AS (SELECT {", ".join(f"{x} AS {c}" for c, x in _WIDE.items())} FROM lineitem),
g AS (SELECT {", ".join(f"corr({a}, {b}) AS r{k}, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n{k}" for k, (a, b) in enumerate(_WIDE_PAIRS))} FROM l),
p AS (SELECT unnest([{", ".join(f"{{'a': '{a}', 'b': '{b}', 'n': n{k}, 'r': r{k}}}" for k, (a, b) in enumerate(_WIDE_PAIRS))}]) AS p FROM g)
SELECT p.a, p.b, p.n, CASE WHEN isfinite(p.r) THEN round(p.r, 6) END AS r FROM p"""
)
def wide_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of eighteen columns with nulls, in one pass."""
    c = K.correlations(table(spark, sf_dir, "lineitem").selectExpr(*[f"{x} AS {c}" for c, x in _WIDE.items()]), list(_WIDE))
    return c.select("a", "b", "n", F.round("correlation", 6).alias("r"))


@query("SELECT l_linenumber + l_orderkey * 10 AS id, round(median(x), 8) AS m FROM (SELECT *, unnest([l_quantity, l_tax * 100, l_discount * 100, l_extendedprice / 1000]) AS x, row_number() OVER () AS rn FROM lineitem) GROUP BY rn, 1")
def row_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median across columns of each row."""
    li = table(spark, sf_dir, "lineitem").selectExpr("l_linenumber + l_orderkey * 10 AS id", "l_quantity AS a", "l_tax * 100 AS b", "l_discount * 100 AS c", "l_extendedprice / 1000 AS d")
    return _round(li.select("id", X.row_median(["a", "b", "c", "d"]).alias("m")))


@query("SELECT l_orderkey, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount FROM lineitem GROUP BY 1")
def variant_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per variant the largest values over its transcripts."""
    return X.aggregate_tx(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_quantity", "l_discount"])


@query("SELECT 'event_type' AS counter, event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.value_counts(table(spark, sf_dir, "events"), "event_type")


@query(
    f"""WITH {SCORES}, q AS (SELECT list_distinct(quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM scores), b AS (SELECT len(list_filter(e, lambda x: score >= x)) AS bin, score, label FROM scores, q),
g AS (SELECT count(*) AS n, abs(avg(score) - avg(label)) AS gap FROM b GROUP BY bin) SELECT round(sum(n * gap) / sum(n), 8) AS ece, round(max(gap), 8) AS mce FROM g"""
)
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(E.calibration_errors(E.calibration(scores(spark, sf_dir))))


@query(
    f"""WITH {SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2 AS r, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM scores),
c AS (SELECT fold, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc FROM r GROUP BY fold),
o AS (SELECT (sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc FROM r)
SELECT round(o.auc, 8) AS oof_auc, round(avg(c.auc), 8) AS mean_auc, round(stddev_pop(c.auc), 8) AS sd_auc, arg_max(fold, c.auc) AS best_fold FROM c, o GROUP BY o.auc"""
)
def fold_aucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(E.fold_summary(scores(spark, sf_dir), "fold"))


@query(
    f"""WITH {SCORES}, t AS (SELECT cohort, score >= 0.8 AS hit FROM scores), n AS (SELECT count(*) FILTER (cohort = 'A' AND hit) AS a, count(*) FILTER (cohort = 'A' AND NOT hit) AS b, count(*) FILTER (cohort = 'N' AND hit) AS c, count(*) FILTER (cohort = 'N' AND NOT hit) AS d FROM t)
SELECT 'High-confidence escape' AS tier, 'A' AS cohort, 'N' AS other, a, b, c, d, round(round(100 * a / (a + b), 1) / round(100 * c / (c + d), 1), 8) AS fold_change, round(a * d / (b * c), 8) AS odds_ratio, round((SELECT least(1.0, sum(CASE WHEN lp <= (base - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1)) + 1e-7 THEN exp(lp) ELSE 0 END)) FROM
  (SELECT base - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS lp FROM (SELECT unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x))), 6) AS p_value
FROM (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS base FROM n)"""
)
def tier_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment of a tier in one cohort over another, with the exact p."""
    return _round(E.tier_enrichment(scores(spark, sf_dir), "High-confidence escape", "A", "N").withColumn("p_value", F.round("p_value", 6)))


@query(
    f"""WITH {SCORES}, t AS (SELECT cohort, CASE WHEN score < 0.2 THEN 'lo' WHEN score >= 0.8 THEN 'hi' END AS k FROM scores)
SELECT cohort, round(100 * count(*) FILTER (k = 'lo') / count(*), 1) AS "High-confidence NMD", round(100 * count(*) FILTER (k = 'hi') / count(*), 1) AS "High-confidence escape" FROM t GROUP BY cohort"""
)
def tier_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of tiers by cohort, as a wide table."""
    return E.tier_pivot(E.tier_breakdown(scores(spark, sf_dir)), ["High-confidence NMD", "High-confidence escape"])


@query(
    """WITH a AS (SELECT p_brand AS feature, avg(p_size) AS m, stddev_samp(p_size) AS s FROM part GROUP BY 1), b AS (SELECT p_brand AS feature, avg(abs(p_retailprice - 950)) AS c FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1)
SELECT coalesce(a.feature, b.feature) AS feature, round(m, 8) AS mean_importance, round(s, 8) AS sd_importance, round(c, 8) AS mean_abs_contribution, CAST(rank() OVER (ORDER BY m DESC NULLS LAST) AS INTEGER) AS importance_rank, CAST(rank() OVER (ORDER BY c DESC NULLS LAST) AS INTEGER) AS contribution_rank FROM a FULL JOIN b ON a.feature = b.feature"""
)
def importance_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return _round(E.importance_rank(p.select(F.col("p_brand").alias("feature"), F.col("p_size").cast("double").alias("importance")), p.filter("p_brand <> 'Brand#1'").select(F.col("p_brand").alias("feature"), (F.col("p_retailprice") - 950).alias("contribution"))))


@query(
    """WITH t AS (SELECT p_brand AS test, least(1.0, avg(p_size) / 100) AS p FROM part GROUP BY 1), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, test) AS k FROM t)
SELECT test, round(p, 8) AS p_value, round(least(1.0, min(p * m / k) OVER (ORDER BY p, test ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS q_value FROM r"""
)
def adjusted_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benjamini-Hochberg over a table of tests."""
    return _round(E.bh_adjust(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("test")).agg(F.least(F.lit(1.0), F.avg("p_size") / 100).alias("p_value"))))


@query(
    f"""WITH {SEQUENCES}, b AS (SELECT doc_id, doc_id % 2 = 1 AS minus, substr(seq, 11, 90) AS x, substr(seq, 121, 81) AS y FROM seqs) SELECT doc_id AS tx, CASE WHEN minus THEN reverse(translate(y, 'ACGT', 'TGCA')) || reverse(translate(x, 'ACGT', 'TGCA')) ELSE x || y END AS seq FROM b"""
)
def spliced_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blocks of each sequence put together from 64-base chunks, by strand."""
    s = sequences(spark, sf_dir)
    genome = s.select(F.col("doc_id").alias("chrom"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.substring("seq", k * 64 + 1, F.lit(64)))).alias("i", "seq")).select("chrom", F.col("i").cast("long").alias("chunk_no"), "seq")
    minus = F.col("doc_id") % 2 == 1
    blocks = s.select(F.col("doc_id").alias("tx"), F.col("doc_id").alias("chrom"), F.when(minus, "-").otherwise("+").alias("strand"), F.explode(F.array(F.struct(F.when(minus, 2).otherwise(1).alias("rank"), F.lit(11).alias("start"), F.lit(100).alias("end")), F.struct(F.when(minus, 1).otherwise(2).alias("rank"), F.lit(121).alias("start"), F.lit(201).alias("end")))).alias("b")).select("tx", "chrom", "strand", "b.*")
    return T.splice_sequence(blocks, genome, 64)


_AA = "[" + ", ".join(f"'{c}'" for c in S.CODONS) + "]", "[" + ", ".join(f"'{a}'" for a in S.CODONS.values()) + "]"


@query(
    f"""WITH {SEQUENCES}, c AS (SELECT doc_id, doc_id % 60 + 5 AS k, seq FROM seqs), a AS (SELECT doc_id, k, list_transform([-2, -1, 1, 2], lambda d: {_AA[1]}[list_position({_AA[0]}, substr(seq, 3 * (k - 1 + d) + 1, 3))]) AS r, seq FROM c)
SELECT doc_id, r[1] AS minus2, r[2] AS minus1, r[3] AS plus1, r[4] AS plus2, r[2] = 'G' AS minus1_gly, CAST((85 - k) * 3 AS BIGINT) AS nt_to_end, round(k / 85 * 100, 2) AS percent FROM a"""
)
def flanking_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues around a codon, and its distances."""
    k = F.col("doc_id") % 60 + 5
    a, d = S.ptc_amino_acids(F.col("seq"), k), S.transcript_distances(k, F.lit(85))
    return sequences(spark, sf_dir).select("doc_id", a.alias("a"), d.alias("d")).select("doc_id", "a.minus2", "a.minus1", "a.plus1", "a.plus2", "a.minus1_gly", "d.nt_to_end", "d.percent")


@query(
    """WITH h AS (SELECT p_partkey % 40 AS id, p_type AS region, split_part(p_name, ' ', 1) AS motif FROM part), g AS (SELECT * FROM (VALUES ('red', 'R1'), ('small', 'S1'), ('blue', 'B1')) t(motif, gene))
SELECT DISTINCT id, region || '.' || gene AS "column" FROM h JOIN g USING (motif)"""
)
def motif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct region and gene columns of motif hits, half of them named with a suffix."""
    first = F.split("p_name", " ")[0]
    hits = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("id"), F.col("p_type").alias("region"), F.when(F.col("p_partkey") % 2 == 0, F.concat(first, F.lit(":x"))).otherwise(first).alias("motif"))
    return M.motif_presence(hits, spark.createDataFrame([("red", "R1"), ("small", "S1"), ("blue", "B1")], "motif string, gene string"))


@query(
    f"""WITH {SEQUENCES} SELECT event_id AS id, substr(seq, CAST(event_id * 37 % 230 + 1 AS INTEGER), 25) AS seq FROM events JOIN seqs ON event_id // 10 = doc_id"""
)
def genome_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of ranges, from an indexed genome of which only the folders with wanted chunks are read."""
    from ptclake.sources.readers import read_genome
    from ptclake.sources.scratch import scratch_path
    from ptclake.sources.writers import write_genome

    path = scratch_path(spark, "genome")
    write_genome(sequences(spark, sf_dir).select(F.concat(F.lit("c"), F.col("doc_id") % 7).alias("chrom"), F.col("doc_id").alias("chunk_no"), "seq"), path, span=256)
    blocks = table(spark, sf_dir, "events").selectExpr("event_id AS tx", "concat('c', event_id div 10 % 7) AS chrom", "'+' AS strand", "1 AS rank", "event_id div 10 * 256 + event_id * 37 % 230 + 1 AS start", "event_id div 10 * 256 + event_id * 37 % 230 + 25 AS end")
    genome = read_genome(spark, path, blocks, chunk=256, span=256)
    return T.splice_sequence(blocks, genome, 256).withColumnRenamed("tx", "id")


@query(
    f"""WITH {MODEL}, v AS (SELECT event_id AS id, event_id // 3 AS tx, event_id * 31 % 1500 + 1 AS p FROM events),
w AS (SELECT v.*, total, c.before + c.len AS ejc FROM v JOIN cdsx c ON v.tx = c.tx AND v.p BETWEEN c.before + 1 AND c.before + c.len),
i AS (SELECT id, tx, unnest(['ptc_to_ejc', 'newutr_all', 'newutr_200', 'ptc_pm100', 'ejc_pm100']) AS region, unnest([p, p, p, greatest(1, p - 100), greatest(1, ejc - 100)]) AS a, unnest([ejc, total, least(p + 199, total), least(total, p + 100), least(total, ejc + 100)]) AS b FROM w),
k AS (SELECT id, region, strand, r AS o, start, "end", before, greatest(a, before + 1) AS lo, least(b, before + len) AS hi FROM i JOIN cdsx c USING (tx)),
d AS (SELECT id, region, 0 AS s, o, CASE WHEN strand = '+' THEN start + lo - before - 1 ELSE "end" - (hi - before - 1) END AS start, CASE WHEN strand = '+' THEN start + hi - before - 1 ELSE "end" - (lo - before - 1) END AS "end" FROM k WHERE lo <= hi),
m AS (SELECT tx, min(start) AS lo, max("end") AS hi FROM cds GROUP BY tx),
u AS (SELECT e.tx, strand, r, CASE WHEN strand = '+' THEN greatest(start, hi + 1) ELSE start END AS start, CASE WHEN strand = '+' THEN "end" ELSE least("end", lo - 1) END AS "end" FROM ex5 e JOIN m USING (tx)),
ux AS (SELECT *, coalesce(sum("end" - start + 1) OVER (PARTITION BY tx ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u WHERE start <= "end"),
a AS (SELECT * FROM d UNION ALL SELECT id, 'newutr_all', 1, r, start, "end" FROM w JOIN ux USING (tx) UNION ALL SELECT id, 'utr3_all', 1, r, start, "end" FROM w JOIN ux USING (tx)
      UNION ALL SELECT id, 'utr3_200', 1, r, CASE WHEN strand = '+' THEN start ELSE greatest(start, "end" - (200 - before) + 1) END, CASE WHEN strand = '+' THEN least("end", start + (200 - before) - 1) ELSE "end" END FROM w JOIN ux USING (tx) WHERE before < 200)
SELECT id, region, CAST(row_number() OVER (PARTITION BY id, region ORDER BY s, o) AS INTEGER) AS rank, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM a"""
)
def motif_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven regions of coding positions that motifs are looked for in."""
    v = table(spark, sf_dir, "events").selectExpr("event_id AS id", "event_id div 3 AS tx", "event_id * 31 % 1500 + 1 AS coding_pos")
    return T.motif_region_blocks(v, T.transcript_model(gene_model(spark, sf_dir))).select("id", "region", "rank", "start", "end")


@query(
    f"""WITH {MODEL}, v AS (SELECT tx, CAST(greatest(1, total // 3) AS BIGINT) AS a, CAST(greatest(1, total // 3) + 60 AS BIGINT) AS b FROM cdsx WHERE r = 1),
p AS (SELECT c.tx, c.r, c.strand, c.start, c."end", greatest(v.a, before + 1) AS lo, least(v.b, before + len) AS hi, before FROM cdsx c JOIN v USING (tx))
SELECT tx AS id, CAST(r AS INTEGER) AS rank, CAST(CASE WHEN strand = '+' THEN start + lo - before - 1 ELSE "end" - (hi - before - 1) END AS BIGINT) AS start, CAST(CASE WHEN strand = '+' THEN start + hi - before - 1 ELSE "end" - (lo - before - 1) END AS BIGINT) AS "end" FROM p WHERE lo <= hi"""
)
def genomic_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding intervals as genomic pieces."""
    m = T.transcript_model(gene_model(spark, sf_dir))
    total = T.block_length(F.col("cds"))
    iv = m.filter(F.size("cds") > 0).select(F.col("tx").alias("id"), "tx", F.greatest(F.lit(1), F.floor(total / 3)).cast("long").alias("from_")).withColumn("to_", F.col("from_") + 60)
    g = T.cds_interval_to_genomic(iv, m)
    return g.select("id", F.col("rank").cast("int").alias("rank"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def _clip(region: str, low: str, high: str, source: str = "p") -> str:
    """Rows of the exons cut to low..high, numbered in transcript order."""
    cut = f"greatest(x.start, {low}) AS a, least(x.\"end\", {high}) AS b"
    return f"SELECT id, '{region}' AS region, chrom, strand, row_number() OVER (PARTITION BY id ORDER BY r) AS rank, a, b FROM (SELECT p.*, x.r, {cut} FROM {source} p JOIN ex5 x ON x.tx = p.tx) WHERE a <= b"


_REGIONS = " UNION ALL ".join(
    [
        "SELECT id, 'ptc_100bp', chrom, strand, 1, pos - 100, pos + 100 FROM p",
        "SELECT id, 'ptc_to_ejc', chrom, strand, 1, least(pos, end3), greatest(pos, end3) FROM p WHERE pos <> end3",
        "SELECT id, 'ejc_100bp', chrom, strand, 1, end3 - 100, end3 + 100 FROM p",
        _clip("new3utr", "CASE WHEN p.strand = '+' THEN pos + 1 ELSE 0 END", "CASE WHEN p.strand = '+' THEN 1000000000 ELSE pos - 1 END"),
        _clip("old3utr", "CASE WHEN p.strand = '+' THEN hi + 1 ELSE 0 END", "CASE WHEN p.strand = '+' THEN 1000000000 ELSE lo - 1 END", "q"),
        _clip("utr5", "CASE WHEN p.strand = '+' THEN 0 ELSE hi + 1 END", "CASE WHEN p.strand = '+' THEN lo - 1 ELSE 1000000000 END", "q"),
        _clip("tx_whole", "0", "1000000000"),
    ]
)


@query(
    f"""WITH {MODEL}, {VARIANTS}, p AS (SELECT v.id, v.tx, v.pos, x.chrom, x.strand, CASE WHEN x.strand = '+' THEN x."end" ELSE x.start END AS end3 FROM variants v JOIN ex5 x ON v.tx = x.tx AND v.pos BETWEEN x.start AND x."end"),
c AS (SELECT tx, min(start) AS lo, max("end") AS hi FROM cds GROUP BY tx), q AS (SELECT p.*, lo, hi FROM p JOIN c ON p.tx = c.tx), u(id, region, chrom, strand, rank, a, b) AS ({_REGIONS})
SELECT id, region, chrom, strand, CAST(rank AS INTEGER) AS rank, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end" FROM u"""
)
def variant_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all regions of the variants on their transcripts."""
    return T.region_blocks(variants(spark, sf_dir), T.transcript_model(gene_model(spark, sf_dir)))


@query(
    f"""WITH {SEQUENCES}, v AS (SELECT doc_id, seq, 3 * (doc_id % 70 + 5) + 1 AS pos, 'C' AS ref, 'T' AS alt FROM seqs),
a AS (SELECT *, pos + list_filter([0, -1, 1, -2, 2, -3, 3], lambda s: substr(seq, CAST(pos + s AS INTEGER), 1) = ref)[1] AS place FROM v),
m AS (SELECT *, substr(seq, 1, CAST(place - 1 AS INTEGER)) || alt || substr(seq, CAST(place + 1 AS INTEGER)) AS made, (place - 1) // 3 * 3 + 1 AS f FROM a),
s AS (SELECT *, f + list_filter([0, -3, 3, -6, 6], lambda s: f + s >= 1 AND substr(made, CAST(f + s AS INTEGER), 3) IN ('TAA', 'TAG', 'TGA'))[1] AS stop FROM m)
SELECT doc_id, CASE WHEN stop > 3 AND stop + 8 <= length(made) THEN substr(made, CAST(stop - 3 AS INTEGER), 12) END AS context FROM s"""
)
def stop_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 bases around the stop that a C>T change at a coding position makes or lies next to."""
    pos = 3 * (F.col("doc_id") % 70 + 5) + 1
    return sequences(spark, sf_dir).select("doc_id", S.readthrough_context(F.col("seq"), pos, F.lit("C"), F.lit("T")).alias("context"))


@query(
    """WITH l AS (SELECT l_quantity AS a, l_quantity * 2 + l_tax AS b, l_discount AS c, l_quantity * 3 - l_tax AS d FROM lineitem),
r AS (SELECT * FROM (SELECT unnest(['a', 'a', 'a', 'b', 'b', 'c']) AS x, unnest(['b', 'c', 'd', 'c', 'd', 'd']) AS y, unnest([corr(a, b), corr(a, c), corr(a, d), corr(b, c), corr(b, d), corr(c, d)]) AS r FROM l))
SELECT DISTINCT CASE WHEN y = 'b' THEN x ELSE y END AS feature FROM r WHERE abs(r) > 0.95"""
)
def pruned_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that the pruning by correlations drops, with one protected."""
    names = ["a", "b", "c", "d"]
    c = K.strong_pairs(K.correlations(table(spark, sf_dir, "lineitem").selectExpr("l_quantity AS a", "l_quantity * 2 + l_tax AS b", "l_discount AS c", "l_quantity * 3 - l_tax AS d"), names))
    return spark.createDataFrame([(x,) for x in K.correlation_prune(names, c, {"b"})], "feature string")


@query(
    """WITH s AS (SELECT event_id AS id, 'k' || event_id AS key, ['stop_gained', 'missense_variant', 'intron|frameshift_variant', 'synonymous'][event_id % 4 + 1] AS ann FROM events), g AS (SELECT 'k' || l_orderkey AS key, l_linenumber AS sample FROM lineitem)
SELECT id, key, ann, sample FROM s JOIN g USING (key) WHERE ann LIKE '%stop_gained%' OR ann LIKE '%frameshift_variant%'"""
)
def annotated_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frameshift and stop sites with their genotypes, by key."""
    s = table(spark, sf_dir, "events").selectExpr("event_id AS id", "concat('k', event_id) AS key", "element_at(array('stop_gained', 'missense_variant', 'intron|frameshift_variant', 'synonymous'), cast(event_id % 4 + 1 AS int)) AS ann")
    g = table(spark, sf_dir, "lineitem").selectExpr("concat('k', l_orderkey) AS key", "l_linenumber AS sample")
    return C.join_annotation_genotype(C.filter_consequence(s), g).select("id", "key", "ann", "sample")


@query(
    """WITH u AS (SELECT user_id, avg(value) AS expr FROM events GROUP BY 1), c AS (SELECT c_custkey AS k, c_acctbal AS cadd FROM customer)
SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 0 END AS target, round(u.expr, 8) AS expr, c.cadd FROM events e LEFT JOIN u ON u.user_id = e.user_id LEFT JOIN c ON c.k = e.event_id"""
)
def gene_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene tables by version-free id and variant tables by key put on variants, unwanted columns dropped, labels mapped."""
    e = table(spark, sf_dir, "events").selectExpr("event_id AS id", "concat('G', user_id, '.3') AS gene_id", "concat('v', event_id) AS key", "CASE event_id % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'FALSE' END AS label", "value", "1 AS GC_extra")
    by_gene = e.groupBy("gene_id").agg(F.round(F.avg("value"), 8).alias("expr"))
    by_key = table(spark, sf_dir, "customer").selectExpr("concat('v', c_custkey) AS key", "c_acctbal AS CADD")
    joined = X.join_gene_features(e, [by_gene], [by_key]).withColumn("target", V.map_target(F.col("label")))
    return X.drop_columns(joined, {"gene_id": "an id", "key": "an id", "label": "mapped", "value": "not a feature"}, ("GC_",), {"cadd": ["cadd_phred", "CADD"]}).select("id", "target", "expr", "cadd")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 20")
def largest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest values, ties by the keys."""
    return E.top_k(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 20, ["l_orderkey", "l_linenumber"])


@query(f"WITH c AS ({_SPARSE}) SELECT c_custkey, bal, seg, CAST(NULL AS DOUBLE) AS gone FROM c")
def aligned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table brought to a model's columns: missing ones added, others left out."""
    return X.align_columns(_sparse(spark, sf_dir), {"bal": "double", "seg": "string", "gone": "double"}, keep=["c_custkey"])


@query("SELECT event_id AS id, user_id FROM events WHERE event_id % 5 = 0")
def stop_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants that an annotation marks as premature stops, in a fixed order."""
    e = table(spark, sf_dir, "events").selectExpr("event_id AS id", "user_id", "CASE event_id % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'NA' END AS is_ptc")
    return E.sort_results(C.filter_ptc(e).select("id", "user_id"), ["id"])
