"""Registered queries of the cohort operators over the given tables, each with DuckDB SQL where that can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ptclake.functions import sequence as S
from ptclake.functions import variants as V
from ptclake.operators import cohorts as C
from ptclake.operators import evaluation as E
from ptclake.operators import features as X
from ptclake.operators import intervals as I
from ptclake.operators import transcripts as T
from ptclake.plans.shapes import LINES, lines, EXONS, MODEL, SCORES, SEQUENCES, VARIANTS, exons, gene_model, scores, sequences, table, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query(
    f"""WITH {MODEL}, {VARIANTS},
loc AS (SELECT v.id, v.tx, c.strand, c.r, c.n, c.len, c.total, CASE WHEN c.strand = '+' THEN v.pos - c.start ELSE c."end" - v.pos END + 1 AS off, c.before FROM variants v JOIN cdsx c ON v.tx = c.tx AND v.pos BETWEEN c.start AND c."end"),
f AS (SELECT id, r = n AS last_exon, off + before AS to_start, len, r = n - 1 AND len - off <= 50 AND len >= 50 AS pen FROM loc),
s AS (SELECT *, CASE WHEN last_exon THEN 'last_exon' WHEN to_start < 150 THEN 'start_proximal' WHEN len > 407 THEN 'long_exon' WHEN pen THEN '50nt_rule' ELSE 'trigger' END AS rule,
      CASE WHEN last_exon THEN 0.0 WHEN to_start < 150 THEN 0.12 WHEN len > 407 THEN 0.41 WHEN pen THEN 0.20 ELSE 0.65 END AS score FROM f)
SELECT rule, CASE WHEN score > 0.52 THEN 'NMD_triggering' WHEN score < 0.25 THEN 'NMD_evading' ELSE 'intermediate' END AS "class", count(*) AS n, round(CAST(avg(score) AS DOUBLE), 8) AS mean_score FROM s GROUP BY 1, 2"""
)
def rule_tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants placed on transcript models, scored by the rule tree and counted by rule."""
    at = T.locate_ptc(variants(spark, sf_dir), T.transcript_model(gene_model(spark, sf_dir))).filter("cds_pos IS NOT NULL")
    last = F.col("coding_rank") == F.col("coding_count")
    r = at.select(V.rule_tree(last, F.col("cds_pos"), F.col("cds_exon_length"), F.col("last_ejc") == "penultimate.last50bp").alias("r")).select("r.*")
    return _round(r.groupBy("rule", "class").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")))


@query(
    f"""WITH {MODEL}, {VARIANTS},
e AS (SELECT v.id, v.tx, v.pos, x.strand, x.r AS exon_rank, x.n AS exon_count, CASE WHEN x.strand = '+' THEN v.pos - x.start ELSE x."end" - v.pos END + 1 AS exon_offset, x."end" - x.start + 1 AS len FROM variants v JOIN ex5 x ON v.tx = x.tx AND v.pos BETWEEN x.start AND x."end"),
c AS (SELECT v.id, c.r, c.n, c.len, c.total, CASE WHEN c.strand = '+' THEN v.pos - c.start ELSE c."end" - v.pos END + 1 AS off, c.before FROM variants v JOIN cdsx c ON v.tx = c.tx AND v.pos BETWEEN c.start AND c."end")
SELECT e.id, e.tx, CAST(exon_rank AS INTEGER) AS exon_rank, CAST(exon_count AS INTEGER) AS exon_count, CAST(exon_offset AS BIGINT) AS exon_offset, CAST(e.len - exon_offset AS BIGINT) AS to_exon_end, CAST(off + before AS BIGINT) AS cds_pos, round((off + before) / total, 8) AS relative,
  CASE WHEN c.r IS NULL THEN NULL WHEN c.r = c.n THEN 'last.exon' WHEN c.r = c.n - 1 AND c.len - c.off <= 50 AND c.len >= 50 THEN 'penultimate.last50bp' ELSE 'upstream' END AS last_ejc
FROM e LEFT JOIN c ON e.id = c.id"""
)
def located_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exon rank and offset, CDS position and last-junction class of each variant that an exon has."""
    at = T.locate_ptc(variants(spark, sf_dir), T.transcript_model(gene_model(spark, sf_dir))).filter("exon_rank IS NOT NULL")
    at = at.withColumn("last_ejc", F.when(F.col("cds_pos").isNotNull(), F.col("last_ejc")))
    return _round(at.select("id", "tx", "exon_rank", "exon_count", F.col("exon_offset").cast("long").alias("exon_offset"), F.col("to_exon_end").cast("long").alias("to_exon_end"), F.col("cds_pos").cast("long").alias("cds_pos"), "relative", "last_ejc"))


@query(
    f"""WITH {MODEL}
SELECT x.tx, CAST(count(c.k) AS INTEGER) AS coding_exons, CAST(count(*) - count(c.k) AS INTEGER) AS noncoding_exons, CAST(sum(x."end" - x.start + 1) - coalesce(sum(c."end" - c.start + 1), 0) AS BIGINT) AS noncoding_bp,
  coalesce((SELECT string_agg(CAST(CAST(before + len AS BIGINT) AS VARCHAR), ',' ORDER BY r) FROM cdsx z WHERE z.tx = x.tx), '') AS cds_exon_ends
FROM exons x LEFT JOIN cds c ON x.tx = c.tx AND x.k = c.k GROUP BY x.tx"""
)
def transcript_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding and non-coding exons and the cumulative CDS exon ends of each transcript."""
    c = T.exon_counts(T.transcript_model(gene_model(spark, sf_dir)))
    return c.withColumn("noncoding_bp", F.col("noncoding_bp").cast("long")).withColumn("cds_exon_ends", F.concat_ws(",", F.col("cds_exon_ends").cast("array<string>")))


@query(
    f"""WITH {MODEL}, {VARIANTS},
j AS (SELECT tx, chrom, strand, CASE WHEN strand = '+' THEN "end" ELSE start END AS junction FROM ex5 WHERE r < n),
near AS (SELECT v.id, v.tx, any_value(strand) AS strand, coalesce(min(CASE WHEN strand = '+' AND junction > pos THEN junction END), max(CASE WHEN strand = '-' AND junction < pos THEN junction END)) AS junction FROM variants v JOIN j ON v.tx = j.tx GROUP BY v.id, v.tx),
w AS (SELECT id, tx, CASE WHEN strand = '+' THEN junction - 24 ELSE junction + 24 END - 15 AS a, CASE WHEN strand = '+' THEN junction - 24 ELSE junction + 24 END + 14 AS b FROM near WHERE junction IS NOT NULL),
iv AS (SELECT event_id // 4 AS tx, 100 + event_id * 53 % 1100 AS start, 100 + event_id * 53 % 1100 + 9 AS "end" FROM events),
n AS (SELECT w.id, count(*) AS n FROM w JOIN iv ON w.tx = iv.tx AND iv.start <= w.b AND w.a <= iv."end" GROUP BY w.id)
SELECT v.id, coalesce(n.n, 0) AS n, CASE WHEN n.n > 0 THEN 'yes' ELSE 'no' END AS "any", CAST(near.junction AS BIGINT) AS junction FROM variants v LEFT JOIN near USING (id) LEFT JOIN n USING (id)"""
)
def junction_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next exon junction behind each variant, and the intervals that touch the window before it."""
    v = variants(spark, sf_dir)
    near = I.nearest_downstream_junction(v, I.junctions(T.exon_rank(exons(spark, sf_dir).drop("k"))))
    iv = table(spark, sf_dir, "events").select(F.expr("event_id div 4").alias("tx"), (100 + F.col("event_id") * 53 % 1100).alias("start"), (100 + F.col("event_id") * 53 % 1100 + 9).alias("end"))
    n = I.count_overlaps(I.ejc_windows(near).select("id", "tx", "start", "end"), iv, "id", ["tx"], v)
    return n.join(near.select("id", F.col("junction").cast("long").alias("junction")), "id", "left")


@query(
    f"""WITH {EXONS}, iv AS (SELECT event_id // 4 AS tx, 100 + event_id * 53 % 1100 AS a, 100 + event_id * 53 % 1100 + 9 AS b FROM events)
SELECT tx, CAST(k AS INTEGER) AS k, start, "end" FROM exons e WHERE EXISTS (SELECT 1 FROM iv WHERE iv.tx = e.tx AND iv.a <= e."end" AND e.start <= iv.b)"""
)
def touched_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons that any interval touches."""
    iv = table(spark, sf_dir, "events").select(F.expr("event_id div 4").alias("tx"), (100 + F.col("event_id") * 53 % 1100).alias("start"), (100 + F.col("event_id") * 53 % 1100 + 9).alias("end"))
    return I.overlap_semi(exons(spark, sf_dir).select("tx", "k", "start", "end"), iv, ["tx"])


_SPAN = "CASE WHEN {0} % 1000 = 1 THEN 100000000 WHEN {0} % 200 = 2 THEN 3000000 WHEN {0} % 40 = 3 THEN 90000 WHEN {0} % 9 = 4 THEN 20000 ELSE {0} % 50 END"


@query(
    f"""WITH l AS (SELECT event_id AS id, event_id % 22 AS chrom, event_id * 7919 % 240000007 AS a, event_id * 7919 % 240000007 + {_SPAN.format("event_id")} AS b FROM events),
r AS (SELECT l_orderkey % 22 AS chrom, l_partkey * 104729 % 240000007 AS a, l_partkey * 104729 % 240000007 + {_SPAN.format("(l_orderkey * 7 + l_linenumber)")} AS b FROM lineitem),
c AS (SELECT l.id, count(*) AS n FROM l JOIN r ON l.chrom = r.chrom AND l.a <= r.b AND r.a <= l.b GROUP BY l.id)
SELECT l.id, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'yes' ELSE 'no' END AS "any" FROM l LEFT JOIN c ON l.id = c.id"""
)
def mixed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For windows of 1 to 100 million bases, the intervals of such lengths that they touch."""
    e, li = table(spark, sf_dir, "events"), table(spark, sf_dir, "lineitem")
    left = e.selectExpr("event_id AS id", "event_id % 22 AS chrom", "event_id * 7919 % 240000007 AS start", f"event_id * 7919 % 240000007 + {_SPAN.format('event_id')} AS end")
    right = li.selectExpr("l_orderkey % 22 AS chrom", "l_partkey * 104729 % 240000007 AS start", f"l_partkey * 104729 % 240000007 + {_SPAN.format('(l_orderkey * 7 + l_linenumber)')} AS end")
    return I.count_overlaps(left, right, "id", ["chrom"], left)


@query(
    f"""WITH {EXONS}, tr AS (SELECT user_id * 9 AS tx, 100 + event_id * 61 % 1100 AS a, 100 + event_id * 61 % 1100 + 19 AS b, value FROM events WHERE value IS NOT NULL),
b AS (SELECT e.tx, tr.value, unnest(range(greatest(e.start, tr.a), least(e."end", tr.b) + 1)) AS base FROM exons e JOIN tr ON tr.tx = e.tx AND tr.a <= e."end" AND e.start <= tr.b),
m AS (SELECT tx, count(*) AS valid_bp, median(value) AS med FROM b GROUP BY tx)
SELECT s.tx, CAST(s.total_bp AS BIGINT) AS total_bp, coalesce(m.valid_bp, 0) AS valid_bp, round(m.med, 8) AS median FROM (SELECT tx, sum("end" - start + 1) AS total_bp FROM exons GROUP BY tx) s LEFT JOIN m USING (tx)"""
)
def region_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median per base of a run-length track over each transcript's exons."""
    track = table(spark, sf_dir, "events").select((F.col("user_id") * 9).alias("tx"), (100 + F.col("event_id") * 61 % 1100).alias("start"), (100 + F.col("event_id") * 61 % 1100 + 19).alias("end"), "value")
    e = exons(spark, sf_dir).select("tx", "start", "end").withColumn("of", F.col("tx"))
    return _round(I.region_median(e, track, ["tx"], ["of"], width=512).withColumnRenamed("of", "tx"))


@query(
    f"""WITH {MODEL}, c AS (SELECT *, coalesce(sum("end" - start + 1) OVER (PARTITION BY tx ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ex5),
t AS (SELECT *, least(200 - before, "end" - start + 1) AS s FROM c WHERE before < 200)
SELECT tx, CAST(r AS INTEGER) AS rank, CAST(CASE WHEN strand = '+' THEN start ELSE "end" - s + 1 END AS BIGINT) AS start, CAST(CASE WHEN strand = '+' THEN start + s - 1 ELSE "end" END AS BIGINT) AS "end" FROM t"""
)
def first_200_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exon pieces of each transcript's first 200 bases."""
    cut = I.take_first_bases(T.exon_rank(exons(spark, sf_dir).drop("k")), ["tx"], 200)
    return cut.select("tx", "rank", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_ANN = "SELECT event_id AS id, 'chr' || (user_id % 22 + 1) AS chrom, event_id * 13 AS pos, substr('ACGT', CAST(event_id % 4 + 1 AS INTEGER), 1) AS ref, CASE WHEN event_id % 7 = 0 THEN 'NN' ELSE substr('ACGT', CAST((event_id + 1 + user_id) % 4 + 1 AS INTEGER), 1) END AS alt FROM events"


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", "concat('chr', user_id % 22 + 1) AS chrom", "event_id * 13 AS pos", "substr('ACGT', cast(event_id % 4 + 1 AS int), 1) AS ref", "CASE WHEN event_id % 7 = 0 THEN 'NN' ELSE substr('ACGT', cast((event_id + 1 + user_id) % 4 + 1 AS int), 1) END AS alt")


@query(
    f"""WITH s AS ({_ANN})
SELECT id, substr(chrom, 4) AS bare, chrom || '_' || pos || '_' || ref || '_' || alt AS variant_id, chrom || ':' || pos || '_' || ref || '>' || alt AS key, CAST(pos AS BIGINT) AS parsed_pos, 'ENST' || id AS tx, id % 3 = 0 AS flag, CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id AS DOUBLE) END AS number FROM s WHERE length(ref) = 1 AND length(alt) = 1 AND alt NOT LIKE '%N%'"""
)
def variant_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNVs with both forms of names, parsed positions, version-free transcripts and coerced flags and numbers."""
    s = C.filter_defined_alt(C.filter_snv(_sites(spark, sf_dir)))
    vid = V.variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"))
    flag = F.when(F.col("id") % 3 == 0, "TRUE").otherwise("n")
    return s.select("id", V.harmonize_chrom(F.col("chrom"), prefix=False).alias("bare"), vid.alias("variant_id"), V.variant_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("key"), V.parse_variant_id(vid)["pos"].alias("parsed_pos"), V.strip_version(F.concat(F.lit("ENST"), F.col("id"), F.lit(".4"))).alias("tx"), V.coerce_bool(flag).alias("flag"), V.coerce_numeric(F.when(F.col("id") % 5 == 0, "NA").otherwise(F.col("id").cast("string"))).alias("number"))


@query(
    """WITH e AS (SELECT event_id AS id, unnest([1, 2]) AS j FROM events)
SELECT id, 'GENE' || (id % 50 + j) AS gene, 'ENST' || (id % 100 + j) AS tx, CASE WHEN j = 1 THEN id % 900 + 1 ELSE id % 500 + 1 END AS coding_pos, CASE WHEN j = 1 THEN 'C' END AS ref, CASE WHEN j = 1 THEN 'T' END AS alt, CASE WHEN j = 1 THEN id % 300 + 1 END AS protein_pos FROM e"""
)
def parsed_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation strings taken apart: an SNV on one transcript, a range on another."""
    e = table(spark, sf_dir, "events").selectExpr("event_id AS id", "concat('GENE', event_id % 50 + 1, ':ENST', event_id % 100 + 1, '.3:exon2:c.C', event_id % 900 + 1, 'T:p.R', event_id % 300 + 1, 'X,GENE', event_id % 50 + 2, ':ENST', event_id % 100 + 2, '.1:exon3:c.', event_id % 500 + 1, '_', event_id % 500 + 4, 'del') AS v3")
    return e.select("id", F.explode(V.parse_annotations(F.col("v3"))).alias("a")).select("id", "a.gene", "a.tx", "a.coding_pos", "a.ref", "a.alt", "a.protein_pos")


@query("""SELECT user_id AS key, count(*) AS freq, CASE WHEN count(*) = 1 THEN 'ultra-rare' ELSE 'rare-common' END AS freq_cat FROM events GROUP BY 1""")
def variant_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per key, and whether it is seen once."""
    return C.variant_frequency(table(spark, sf_dir, "events").withColumnRenamed("user_id", "key"))


_COUNTS = "SELECT user_id AS key, event_id AS read_id, CAST(floor(value) AS BIGINT) + 1 AS ref_count, CAST(floor(value * 7) % 40 AS BIGINT) AS alt_count FROM events WHERE value IS NOT NULL"


@query(
    f"""WITH c AS (SELECT key, read_id, ref_count, ref_count + alt_count AS total FROM ({_COUNTS}) WHERE ref_count + alt_count >= 8),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY read_id) - 1 AS i FROM c), n AS (SELECT key, count(*) AS n FROM c GROUP BY key),
d AS (SELECT key, CAST('0x' || substr(md5(key || ':' || t), 1, 8) AS BIGINT) % n AS i FROM n, range(100) r(t)),
r AS (SELECT d.key, median(ref_count / total) AS ratio FROM d JOIN o ON d.key = o.key AND d.i = o.i GROUP BY d.key)
SELECT key, round(ratio, 8) AS ratio, CASE WHEN ratio BETWEEN 0.35 AND 0.65 THEN true WHEN ratio > 0.65 THEN false END AS escape FROM r"""
)
def escape_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from the median allele ratio of 100 draws of one read row per variant."""
    c = table(spark, sf_dir, "events").filter("value IS NOT NULL").select(F.col("user_id").alias("key"), F.col("event_id").alias("read_id"), (F.floor("value").cast("long") + 1).alias("refCount"), (F.floor(F.col("value") * 7) % 40).cast("long").alias("altCount"))
    return _round(C.ase_resample(C.filter_min_depth(c.withColumn("totalCount", F.col("refCount") + F.col("altCount")))))


@query(
    f"""WITH c AS (SELECT * FROM ({_COUNTS}))
SELECT read_id, round(1 - alt_count / (ref_count + alt_count), 8) AS alt_loss, round(log2((ref_count + 1) / (alt_count + 1)), 8) AS log_ratio,
CASE WHEN ref_count / (ref_count + alt_count) < 0.2 THEN 'High-confidence NMD' WHEN ref_count / (ref_count + alt_count) < 0.35 THEN 'Likely NMD' WHEN ref_count / (ref_count + alt_count) < 0.65 THEN 'Ambiguous' WHEN ref_count / (ref_count + alt_count) < 0.8 THEN 'Likely escape' ELSE 'High-confidence escape' END AS tier,
CASE WHEN ref_count < 100 THEN '0-100' WHEN ref_count < 200 THEN '100-200' WHEN ref_count < 300 THEN '200-300' WHEN ref_count < 700 THEN '300-700' ELSE '700+' END AS position_bin,
CASE WHEN alt_count <= 2 THEN '0-2' WHEN alt_count <= 5 THEN '3-5' WHEN alt_count <= 9 THEN '6-9' WHEN alt_count <= 14 THEN '10-14' ELSE '15+' END AS ejc_bin,
CASE WHEN ref_count < 50 THEN 'very_close' WHEN ref_count < 100 THEN 'close' WHEN ref_count < 200 THEN 'moderate' WHEN ref_count < 500 THEN 'far' ELSE 'very_far' END AS aug_bin,
CASE WHEN alt_count / 40 < 0.2 THEN 'constrained' WHEN alt_count / 40 < 0.6 THEN 'intermediate' ELSE 'tolerant' END AS loeuf_cat FROM c"""
)
def ratio_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele ratios, tiers and category bins of counts."""
    c = table(spark, sf_dir, "events").filter("value IS NOT NULL").select(F.col("event_id").alias("read_id"), (F.floor("value").cast("long") + 1).alias("r"), (F.floor(F.col("value") * 7) % 40).cast("long").alias("a"))
    x = V.allele_ratios(F.col("r"), F.col("a"), F.col("r") + F.col("a"))
    return _round(c.select("read_id", x["alt_loss"].alias("alt_loss"), x["log_ratio"].alias("log_ratio"), V.assign_tier(x["ref_share"]).alias("tier"), V.position_bin(F.col("r")).alias("position_bin"), V.downstream_ejc_bin(F.col("a")).alias("ejc_bin"), V.aug_distance_bin(F.col("r")).alias("aug_bin"), V.constraint_bins(F.col("a") / 40, F.lit(0.5))["loeuf_cat"].alias("loeuf_cat")))


@query(
    f"""WITH {SEQUENCES}
SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS revcomp, round((length(seq) - length(translate(seq, 'GC', ''))) / 256, 8) AS gc, round((200 - length(translate(substr(seq, 57), 'AT', ''))) / 200, 8) AS au_last200,
CAST(len(list_filter(range(1, 255, 3), lambda i: substr(seq, i, 3) = 'ATG')) AS INTEGER) AS inframe_atgs,
len(list_filter(range(1, 255), lambda i: substr(seq, i, 3) = 'ATG' AND len(list_filter(range(i + 3, 255, 3), lambda j: substr(seq, j, 3) IN ('TAA', 'TAG', 'TGA'))) > 0)) > 0 AS uorf,
round(len(list_filter(range(1, 255, 3), lambda i: substr(seq, i, 3) IN ('CTG', 'GCC', 'AAG', 'GTT'))) / 85, 8) AS optimal, round(log2(256.0), 8) AS log2_length FROM seqs"""
)
def sequence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base contents, upstream frames, in-frame starts and codon optimality of sequences."""
    s = F.col("seq")
    return _round(sequences(spark, sf_dir).select("doc_id", S.revcomp(s).alias("revcomp"), S.base_content(s, "GC").alias("gc"), S.base_content(s, "AT", last=200).alias("au_last200"), F.size(S.inframe_atgs(s)).alias("inframe_atgs"), S.has_uorf(s).alias("uorf"), S.codon_optimality(s, F.lit(120), ["CUG", "GCC", "AAG", "GUU"])["whole"].alias("optimal"), S.log2_length(s, 10)["log2"].alias("log2_length")))


@query(
    f"""WITH {SEQUENCES}, a AS (SELECT doc_id, seq, 31 AS p FROM seqs),
d AS (SELECT *, list_min(list_filter(range(p + 3, 255, 3), lambda i: substr(seq, i, 3) = 'ATG')) AS x, list_min(list_filter(range(p + 1, 255, 3), lambda i: substr(seq, i, 3) = 'ATG')) AS y, list_min(list_filter(range(p + 2, 255, 3), lambda i: substr(seq, i, 3) = 'ATG')) AS z FROM a),
k AS (SELECT *, CASE substr(seq, x - 3, 1) WHEN 'A' THEN 3 WHEN 'G' THEN 2 ELSE 0 END + CASE WHEN substr(seq, x + 4, 1) = 'G' THEN 3 ELSE 0 END + CASE WHEN substr(seq, x - 6, 1) = 'A' THEN 1 ELSE 0 END + CASE WHEN substr(seq, x + 3, 1) = 'C' THEN 1 ELSE 0 END AS kz FROM d)
SELECT doc_id, CAST(x - p AS INTEGER) AS inframe_distance, CAST(y - p AS INTEGER) AS plus1_distance, CAST(z - p AS INTEGER) AS plus2_distance, CASE WHEN y IS NOT NULL AND z IS NOT NULL THEN 'both' WHEN y IS NOT NULL THEN 'plus1' WHEN z IS NOT NULL THEN 'plus2' ELSE 'none' END AS frames,
CASE WHEN x IS NULL THEN 'insufficient_sequence' WHEN kz >= 5 THEN 'strong' WHEN kz >= 3 THEN 'moderate' WHEN kz >= 1 THEN 'weak' ELSE 'very_weak' END AS kozak FROM k"""
)
def downstream_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts behind a stop at base 31, in frame and out of it, with the Kozak strength of the first in frame."""
    a = sequences(spark, sf_dir).withColumn("d", S.downstream_augs(F.col("seq"), F.lit(31)))
    return a.select("doc_id", "d.inframe_distance", "d.plus1_distance", "d.plus2_distance", V.aug_frame_status(F.col("d.plus1_distance"), F.col("d.plus2_distance")).alias("frames"), S.kozak(F.col("seq"), F.col("d.inframe"))["strength"].alias("kozak"))


def _readthrough_sql() -> str:
    case = lambda base, t: "CASE " + base + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + " ELSE 0 END"
    per = lambda place, by: "CASE stop " + " ".join(f"WHEN '{s}' THEN {case(f'substr(c, {place}, 1)', t)}" for s, t in by.items()) + " ELSE 0 END"
    nine = "CASE stop " + " ".join(f"WHEN '{s}' THEN CASE WHEN substr(c, 12, 1) = '{b}' THEN {x} ELSE {y} END" for s, (b, x, y) in S.PLUS9_POINTS.items()) + " ELSE 0 END"
    total = " + ".join([case("stop", S.STOP_POINTS), case("substr(c, 7, 1)", S.PLUS4_POINTS), "2", per(8, S.PLUS5_POINTS), per(9, S.PLUS6_POINTS), per(10, S.PLUS7_POINTS), nine, "CASE WHEN substr(c, 1, 1) = 'T' THEN 6 ELSE 2 END"])
    return f"""WITH {SEQUENCES}, x AS (SELECT doc_id, substr(seq, 1, 3) || ['TAA', 'TAG', 'TGA'][doc_id % 3 + 1] || substr(seq, 7, 6) AS c FROM seqs), y AS (SELECT *, substr(c, 4, 3) AS stop FROM x),
z AS (SELECT doc_id, c AS context, round(least({total}, 84) / 84 * 100, 2) AS score FROM y) SELECT *, CASE WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'moderate' WHEN score >= 30 THEN 'low' ELSE 'very_low' END AS category FROM z"""


@query(_readthrough_sql())
def readthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readthrough scores of 12-base contexts around each kind of stop."""
    stop = F.element_at(F.array(*[F.lit(s) for s in ("TAA", "TAG", "TGA")]), (F.col("doc_id") % 3 + 1).cast("int"))
    c = sequences(spark, sf_dir).withColumn("context", F.concat(F.substring("seq", 1, 3), stop, F.substring("seq", 7, 6)))
    return c.select("doc_id", "context", S.readthrough_score(F.col("context")).alias("r")).select("doc_id", "context", "r.*")


@query(
    f"""WITH {SCORES}, b AS (SELECT count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 1 AND score < 0.5) AS fn FROM scores)
SELECT tp, fp, tn, fn, round(tp / (tp + fn), 8) AS sensitivity, round(tn / (tn + fp), 8) AS specificity, round(tp / (tp + fp), 8) AS ppv, round(tn / (tn + fn), 8) AS npv, round((tp + tn) / (tp + fp + tn + fn), 8) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 8) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 8) AS balanced_accuracy FROM b"""
)
def confusion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(E.binary_metrics(scores(spark, sf_dir), 0.5))


_RANKS = "SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2 AS r FROM scores"


@query(
    f"""WITH {SCORES}, r AS ({_RANKS}), c AS (SELECT fold, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, sum(r) FILTER (label = 1) AS s FROM r GROUP BY fold)
SELECT fold, n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 8) AS roc_auc FROM c"""
)
def auc_by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC-AUC with ties, per fold."""
    return _round(E.within_bin_auc(scores(spark, sf_dir), "fold"))


@query(
    f"""WITH {SCORES}, g AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM scores GROUP BY score), t AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM g WINDOW w AS (ORDER BY score DESC)),
x AS (SELECT score, tp / pos AS sens, 1 - fp / neg AS spec FROM t)
SELECT * FROM (SELECT 'youden' AS rule, score AS threshold, round(sens, 8) AS sensitivity, round(spec, 8) AS specificity FROM x ORDER BY round(sens + spec - 1, 12) DESC, score DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'at_specificity', score, round(sens, 8), round(spec, 8) FROM x WHERE spec >= 0.9 ORDER BY sens DESC, spec DESC, score DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'at_sensitivity', score, round(sens, 8), round(spec, 8) FROM x WHERE sens >= 0.9 ORDER BY spec DESC, sens DESC, score DESC LIMIT 1)"""
)
def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Youden, target-specificity and target-sensitivity thresholds."""
    return _round(E.threshold_at(E.score_table(scores(spark, sf_dir))))


@query(
    f"""WITH {SCORES}, q AS (SELECT list_distinct(quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM scores), b AS (SELECT len(list_filter(e, lambda x: score >= x)) AS bin, score, label FROM scores, q)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(score), 8) AS mean_score, round(avg(label), 8) AS rate, round(abs(avg(score) - avg(label)), 8) AS gap FROM b GROUP BY bin"""
)
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability by quantile bin."""
    return _round(E.calibration(scores(spark, sf_dir)))


@query(
    f"""WITH {SCORES}, t AS (SELECT *, CASE WHEN score < 0.2 THEN 'High-confidence NMD' WHEN score < 0.35 THEN 'Likely NMD' WHEN score < 0.65 THEN 'Ambiguous' WHEN score < 0.8 THEN 'Likely escape' ELSE 'High-confidence escape' END AS tier FROM scores),
g AS (SELECT cohort, tier, count(*) AS n, avg(score) AS m, avg(label) AS r FROM t GROUP BY 1, 2 UNION ALL SELECT cohort, 'TOTAL', count(*), avg(score), avg(label) FROM t GROUP BY 1)
SELECT cohort, tier, n, round(100 * n / max(n) OVER (PARTITION BY cohort), 1) AS pct, round(m, 8) AS mean_score, round(r, 8) AS rate, round(m - r, 8) AS calibration_gap FROM g"""
)
def cohort_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of each cohort with totals."""
    return _round(E.tier_breakdown(scores(spark, sf_dir)))


@query(
    f"""WITH {SCORES}, s AS (SELECT avg((score - label) ** 2) AS brier, avg(-(label * ln(greatest(1e-15, least(1 - 1e-15, score))) + (1 - label) * ln(1 - greatest(1e-15, least(1 - 1e-15, score))))) AS ll FROM scores),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM scores), a AS (SELECT (sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc FROM r)
SELECT round(auc, 8) AS roc_auc, round(brier, 8) AS brier, round(ll, 6) AS log_loss FROM s, a"""
)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC, Brier score and log loss over all scores."""
    s = scores(spark, sf_dir)
    m = E.brier_log_loss(s).withColumn("log_loss", F.round("log_loss", 6))
    return _round(E.roc_pr(E.score_table(s)).select("roc_auc").crossJoin(m))


#: Groups of twenty events; a fifth of the groups have values that repeat.
_GROUPS = "SELECT 'p' || (event_id {0} 20) AS motif, CAST(event_id % 3 = 0 AS INTEGER) AS present, CASE WHEN event_id {0} 20 % 5 = 0 THEN event_id * 7919 % 11 ELSE event_id * 7919 % 100003 END + 0.25 * (event_id % 3) AS value FROM events"


@query(
    f"""WITH RECURSIVE v AS ({_GROUPS.format("//")}), r AS (SELECT *, rank() OVER (PARTITION BY motif ORDER BY value) + (count(*) OVER (PARTITION BY motif, value) - 1) / 2 AS rank, count(*) OVER (PARTITION BY motif, value) AS ties FROM v),
m AS (SELECT motif, CAST(count(*) FILTER (present = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (present = 0) AS DOUBLE) AS n0, sum(rank) FILTER (present = 1) AS w, sum(ties * ties - 1) AS tie FROM r GROUP BY motif HAVING n1 >= 2 AND n0 >= 2),
size AS (SELECT max(n1) AS most, max(n1 + n0) AS everything FROM m),
c(r, k, s, ways) AS (SELECT 0, 0, 0, CAST(1 AS DOUBLE) UNION ALL
  SELECT r + 1, kk, ss, sum(ways) FROM (SELECT r, k AS kk, s AS ss, ways FROM c UNION ALL SELECT r, k + 1, s + r + 1, ways FROM c), size WHERE r < everything AND kk <= most GROUP BY r, kk, ss),
x AS (SELECT motif, n1, n0, true AS "exact", least(1, 2 * least(sum(ways) FILTER (s <= w), sum(ways) FILTER (s >= w)) / sum(ways)) AS p FROM m JOIN c ON c.r = n1 + n0 AND c.k = n1 WHERE tie = 0 GROUP BY motif, n1, n0),
z AS (SELECT motif, n1, n0, w - n1 * (n1 + 1) / 2 - n0 * n1 / 2 AS u, sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - tie / ((n0 + n1) * (n0 + n1 - 1)))) AS sigma FROM m WHERE tie > 0),
y AS (SELECT *, abs((u - sign(u) * 0.5) / sigma) / sqrt(2) AS a, 1 / (1 + 0.3275911 * (abs((u - sign(u) * 0.5) / sigma) / sqrt(2))) AS t FROM z),
p AS (SELECT * FROM x UNION ALL SELECT motif, n1, n0, false, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-a * a) FROM y),
q AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS t FROM p)
SELECT motif, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, "exact", round(p, 7) AS p_value, round(least(1, min(p * t / i) OVER (ORDER BY p, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 7) AS q_value FROM q"""
)
def motif_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank-sum tests with their q: exact for groups without ties (the counts of U by taking up one rank after the other), approximate for the others."""
    v = table(spark, sf_dir, "events").selectExpr("concat('p', event_id div 20) AS motif", "cast(event_id % 3 = 0 AS int) AS present", "CASE WHEN event_id div 20 % 5 = 0 THEN event_id * 7919 % 11 ELSE event_id * 7919 % 100003 END + 0.25D * (event_id % 3) AS value")
    return _round(E.motif_effect(v).select("motif", "n1", "n0", "exact", "p_value", "q_value"), 7)


_FOLDED = "SELECT l_orderkey % 4 AS fold, CASE WHEN l_linenumber % 5 > 0 THEN l_extendedprice END AS price, CAST(l_quantity AS DOUBLE) AS quantity, CASE WHEN l_orderkey % 4 = 2 THEN l_tax END AS tax FROM lineitem"


@query(
    f"""WITH x AS ({_FOLDED}), y AS (SELECT fold, unnest(['price', 'quantity', 'tax']) AS feature, unnest([price, quantity, tax]) AS value FROM x)
SELECT feature, CAST(k AS INTEGER) AS fold, round(median(value) FILTER (fold <> k), 8) AS median FROM y, range(4) f(k) GROUP BY 1, 2"""
)
def left_out_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column's median over all folds but the one, from one count of its values."""
    x = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 4 AS fold", "CASE WHEN l_linenumber % 5 > 0 THEN l_extendedprice END AS price", "l_quantity AS quantity", "CASE WHEN l_orderkey % 4 = 2 THEN l_tax END AS tax")
    return _round(X.fold_medians(x, ["price", "quantity", "tax"], "fold", 4))


@query(
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS seg, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM customer)
SELECT unnest(['bal', 'seg', 'nation', 'gone', 'absent', 'c_custkey']) AS feature, unnest(['present', 'present', 'present', 'missing', 'missing', 'extra']) AS status,
unnest([count(*) - count(bal), count(*) - count(seg), 0, count(*), count(*), NULL]) AS n_null, unnest([0, 0, count(*) FILTER (nation = 'x'), 0, 0, NULL]) AS n_lost,
unnest([count(*) - count(bal), count(*) - count(seg), 0, count(*), 0, NULL]) AS n_filled, unnest([0, 0, count(*) FILTER (nation = 'x'), 0, count(*), NULL]) AS n_residual FROM c"""
)
def written_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table aligned to a model's columns and filled, with what was null, lost, filled and left counted while it is written."""
    from ptclake.sources.scratch import scratch_path

    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal", "CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS seg", "CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE cast(c_nationkey AS string) END AS nation")
    model = {"bal": "double", "seg": "string", "nation": "double", "gone": "string", "absent": "double"}
    return X.write_aligned(c, model, scratch_path(spark, "aligned"), {"bal": 1.5, "seg": "MISSING", "gone": "MISSING"})


@query(
    """SELECT o_orderkey AS id, o_totalprice, n AS n_lines, q AS quantity FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) a ON o_orderkey = a.l_orderkey LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_discount > 0.02 GROUP BY 1) b ON o_orderkey = b.l_orderkey"""
)
def bucketed_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with two annotation tables, all in buckets of their key, so that the joins shuffle nothing."""
    import uuid

    from ptclake.sources.writers import write_bucketed

    run, buckets = uuid.uuid4().hex[:12], int(spark.conf.get("spark.sql.shuffle.partitions"))
    li = table(spark, sf_dir, "lineitem")
    parts = {"variants": table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_totalprice"), "lines": li.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n_lines")), "sums": li.filter("l_discount > 0.02").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("quantity"))}
    base, *others = (write_bucketed(df, f"annotations_{name}_{run}", "id", buckets) for name, df in parts.items())
    return X.merge_annotations(base, others, "id")


_LONG = "SELECT l_shipdate_m AS motif, present, value FROM (SELECT 'm' || (l_suppkey % 10) AS l_shipdate_m, CAST(l_partkey % 3 = 0 AS INTEGER) AS present, l_discount * 100 + l_quantity AS value FROM lineitem)"


@query(
    f"""WITH v AS ({_LONG}) SELECT motif, count(*) FILTER (present = 1) AS n1, count(*) FILTER (present = 0) AS n0, round(avg(value) FILTER (present = 1), 6) AS mean1, round(avg(value) FILTER (present = 0), 6) AS mean0,
round(avg(value) FILTER (present = 1) - avg(value) FILTER (present = 0), 6) AS diff, round(sqrt(var_samp(value) FILTER (present = 1) / count(*) FILTER (present = 1) + var_samp(value) FILTER (present = 0) / count(*) FILTER (present = 0)), 6) AS se FROM v GROUP BY motif"""
)
def motif_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean differences of a value by the presence of each motif."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("m"), (F.col("l_suppkey") % 10).cast("string")).alias("motif"), (F.col("l_partkey") % 3 == 0).cast("int").alias("present"), (F.col("l_discount") * 100 + F.col("l_quantity")).alias("value"))
    return _round(E.motif_effect(li).select("motif", "n1", "n0", "mean1", "mean0", "diff", "se"), 6)


@query(
    """SELECT feature, count(*) AS n_rows, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS min, max(value) AS max, round(100 * count(value) / count(*), 2) AS pct, coalesce(stddev_samp(value) < 1e-10, true) AS zero_variance
FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'one']) AS feature, unnest([l_quantity, l_discount, l_tax, 1.0]) AS value FROM lineitem) GROUP BY feature"""
)
def feature_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, moments and zero variance of numeric columns."""
    return _round(X.feature_profile(table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0)), ["l_quantity", "l_discount", "l_tax", "one"]), 6)


@query(
    """WITH c AS (SELECT c_custkey AS id, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS zero FROM customer), m AS (SELECT median(bal) AS md FROM c)
SELECT id, round(coalesce(bal, md), 8) AS bal, coalesce(seg, 'MISSING') AS seg, coalesce(zero, 0.0) AS zero FROM c, m"""
)
def imputed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MISSING for categories, structural zeros, medians for the rest."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS bal", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS seg", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE cast(c_nationkey AS double) END AS zero")
    return _round(X.impute(c, ["seg"], ["zero"], ["bal", "zero"]))


@query(
    """WITH a AS (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT c_custkey, c_nationkey, c_acctbal, n_orders, round(total, 2) AS total, n_name, CASE WHEN r.c > 0 THEN true END AS has_open FROM customer LEFT JOIN a ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey AS k, count(*) AS c FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) r ON c_custkey = r.k"""
)
def merged_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of left joins by one key, only new columns taken."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    agg = o.groupBy("c_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    seen = o.filter("o_orderstatus = 'O'").groupBy("c_custkey").agg(F.lit(True).alias("has_open"), F.lit(0).alias("n_orders"))
    merged = X.merge_annotations(base, [agg, seen], "c_custkey")
    return X.merge_annotations(merged, [table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")], "c_nationkey").select("c_custkey", "c_nationkey", "c_acctbal", "n_orders", "total", "n_name", "has_open")


@query(
    """WITH h AS (SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_partkey % 3 = 0), s AS (SELECT p_brand, min_by(p_retailprice, 'G' || p_partkey) AS v FROM h GROUP BY 1)
SELECT p.p_partkey AS id, coalesce(h.p_retailprice, s.v) AS half_life, CASE WHEN h.p_retailprice IS NOT NULL THEN 'gene_id' WHEN s.v IS NOT NULL THEN 'symbol' END AS half_life_from FROM part p LEFT JOIN h ON p.p_partkey = h.p_partkey LEFT JOIN s ON p.p_brand = s.p_brand"""
)
def halflife_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-life by gene, else by symbol."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene_id"), F.col("p_brand").alias("symbol"), "p_retailprice")
    h = p.filter("id % 3 = 0").select("gene_id", "symbol", F.col("p_retailprice").alias("half_life"))
    return X.halflife_with_fallback(p.select("id", F.concat("gene_id", F.lit(".2")).alias("gene_id"), "symbol"), h).select("id", "half_life", "half_life_from")


@query(
    """WITH v AS (SELECT event_id, user_id, value FROM events), low AS (SELECT user_id FROM v GROUP BY 1 HAVING avg(value) <= 9)
SELECT event_id AS id, user_id FROM v WHERE user_id NOT IN (SELECT user_id FROM low) AND event_id % 13 <> 0 AND user_id % 17 <> 3"""
)
def filtered_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants left after anti-joins with gene and variant lists."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.concat(F.lit("G"), F.col("user_id"), F.lit(".1")).alias("gene_id"), F.concat(F.lit("v"), F.col("event_id")).alias("variant_id"), "value")
    low = e.groupBy("gene_id").agg(F.avg("value").alias("value"))
    eqtl = e.select(F.concat("variant_id", F.lit("_b38")).alias("variant_id"), F.when(F.col("id") % 13 == 0, 0.01).otherwise(0.5).alias("qval"))
    imprinted = e.filter("user_id % 17 = 3").select("gene_id")
    return C.anti_filters(e, low_expression=low, eqtl=eqtl, imprinted=imprinted, least=9.0).select("id", "user_id")


@query(
    """WITH m AS (SELECT *, md5(concat_ws('|', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), event_type) || '|') AS h FROM events)
SELECT arg_min(event_id, h) AS event_id, user_id, arg_min(event_type, h) AS event_type FROM m GROUP BY user_id"""
)
def one_variant_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key by the least digest."""
    return C.one_per_key(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id")


@query(
    """WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), o AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT k AS c_custkey, 'missing' AS side FROM a WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT k, 'common' FROM a WHERE k IN (SELECT k FROM o)"""
)
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with and without results, appended."""
    c = table(spark, sf_dir, "customer").select("c_custkey").distinct()
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return C.union_cohorts(C.missing_keys(c, o, "c_custkey").withColumn("side", F.lit("missing")), C.common_variants(c, o, "c_custkey").withColumn("side", F.lit("common")))


@query(
    f"""WITH {MODEL}, l AS (SELECT tx, sum("end" - start + 1) AS exon_length FROM exons GROUP BY tx), d AS (SELECT tx, sum(len) AS cds_length FROM cdsx GROUP BY tx),
t AS (SELECT l.tx, l.exon_length, coalesce(d.cds_length, 0) AS cds_length, max(CASE WHEN l_suppkey % 11 = 0 THEN 1 ELSE 0 END) AS mane, min(CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey % 5 END) AS appris, min(CASE WHEN l_tax > 0.02 THEN CAST(l_linenumber AS INTEGER) END) AS tsl
      FROM l LEFT JOIN d ON l.tx = d.tx JOIN lineitem ON l_orderkey = l.tx GROUP BY 1, 2, 3),
r AS (SELECT event_id AS id, t.*, row_number() OVER (PARTITION BY event_id ORDER BY mane DESC, appris ASC NULLS LAST, tsl ASC NULLS LAST, cds_length DESC, exon_length DESC, t.tx) AS k FROM events JOIN orders ON o_custkey = user_id JOIN t ON t.tx = o_orderkey)
SELECT id, tx, CASE WHEN mane = 1 THEN 'MANE' WHEN appris IS NOT NULL THEN 'APPRIS' WHEN tsl IS NOT NULL THEN 'TSL' ELSE 'longest_CDS' END AS reason FROM r WHERE k = 1"""
)
def canonical_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical transcript of each variant among its customer's orders, by the tags and lengths of all transcripts, with the reason."""
    tags = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS tx", "CASE WHEN l_suppkey % 11 = 0 THEN 1 ELSE 0 END AS mane", "CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey % 5 END AS appris", "CASE WHEN l_tax > 0.02 THEN cast(l_linenumber AS int) END AS tsl")
    meta = T.transcript_meta(tags, T.transcript_model(gene_model(spark, sf_dir)))
    pairs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("o_custkey")).join(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("tx")), "o_custkey")
    return T.pick_canonical(pairs.join(meta, "tx")).select("id", "tx", "reason")


@query(
    f"""WITH {EXONS}, m AS (SELECT DISTINCT 'T' || tx || '.' || (tx % 3) AS name, 'T' || tx AS bare FROM exons), v AS (SELECT event_id AS id, 'T' || (event_id // 2) || '.' || (event_id % 2) AS tx FROM events),
l AS (SELECT bare, min(name) AS name FROM m GROUP BY bare)
SELECT v.id, v.tx, coalesce(m.name, l.name) AS transcript_id_used, m.name IS NULL AND l.name IS NOT NULL AS version_mismatch, m.name IS NULL AND l.name IS NULL AS tx_not_in_gtf
FROM v LEFT JOIN m ON v.tx = m.name LEFT JOIN l ON regexp_replace(v.tx, '\\.\\d+$', '') = l.bare"""
)
def transcript_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript names found exactly or without their version."""
    m = exons(spark, sf_dir).select(F.concat(F.lit("T"), F.col("tx"), F.lit("."), F.col("tx") % 3).alias("tx")).distinct()
    v = table(spark, sf_dir, "events").selectExpr("event_id AS id", "concat('T', event_id div 2, '.', event_id % 2) AS tx")
    return T.lookup_transcript(v, m)


@query(
    """SELECT feature, count(*) AS n, count(*) FILTER (same) AS n_same, max(gap) AS max_gap FROM (SELECT unnest(['c_acctbal', 'c_mktsegment']) AS feature, unnest([abs(c_acctbal - y) <= 0.001 OR c_acctbal = y, true]) AS same, unnest([abs(c_acctbal - y), NULL]) AS gap
FROM (SELECT *, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS y FROM customer)) GROUP BY 1"""
)
def table_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two feature tables by column."""
    a = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return X.compare_tables(a, a.withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))), "c_custkey")


@query(
    """WITH m AS (SELECT avg(s_acctbal) AS a, stddev_samp(s_acctbal) AS s, quantile_cont(s_acctbal, [1/3, 2/3]) AS q FROM supplier) SELECT c_custkey, round((c_acctbal - a) / s, 8) AS z, CASE WHEN c_acctbal <= q[1] THEN 'low' WHEN c_acctbal <= q[2] THEN 'medium' ELSE 'high' END AS tertile FROM customer, m"""
)
def reference_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z and thirds by another cohort's distribution."""
    ref = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("c_acctbal"))
    return _round(X.zscore_tertiles(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", ref)).select("c_custkey", "z", "tertile")


@query()
def bootstrap_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the AUC over 1000 Poisson-weighted replicates."""
    from ptclake.operators.bootstrap import bootstrap_ci

    return bootstrap_ci(scores(spark, sf_dir))


def _line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).selectExpr("id", "l_quantity", "l_discount", "l_extendedprice", "l_returnflag", "cast(l_partkey AS string) AS part", "cast(l_quantity + l_tax * 500 > 40 AS int) AS label", "l_shipdate")


_NUMERIC, _CATEGORICAL = ["l_quantity", "l_discount", "l_extendedprice"], ["l_returnflag", "part"]


@query()
def out_of_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees trained and scored by fold on line items, parts as categories, with isotonic scores beside them."""
    from ptclake.operators.models import isotonic_recalibrate, train_oof
    from ptclake.sources.scratch import written

    li = written(_line_features(spark, sf_dir).select("id", "label", *_NUMERIC, *_CATEGORICAL), "line-features")
    return isotonic_recalibrate(train_oof(li, _NUMERIC, _CATEGORICAL, "label", "id", max_iter=10))


@query(
    f"""WITH {LINES}, x AS (SELECT id, CAST(l_quantity + l_tax * 500 > 40 AS INTEGER) AS y, md5('42:' || id) AS o, l_returnflag AS a, CAST(l_partkey AS VARCHAR) AS b FROM lines),
s AS (SELECT id, (coalesce(sum(y) OVER (PARTITION BY a ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5) / (count(*) OVER (PARTITION BY a ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS x,
             (coalesce(sum(y) OVER (PARTITION BY b ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5) / (count(*) OVER (PARTITION BY b ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS y FROM x)
SELECT id, round(x, 8) AS l_returnflag_statistic, round(y, 8) AS part_statistic FROM s"""
)
def ordered_category_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each line sees of its return flag's and its part's labels: those of the lines before it in a permutation."""
    from ptclake.operators.encoding import ordered_statistics

    out = ordered_statistics(_line_features(spark, sf_dir).select("id", "label", *_CATEGORICAL), _CATEGORICAL, "label", "id")
    return _round(out.select("id", "l_returnflag_statistic", "part_statistic"))


@query()
def fold_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by importance over the folds and by mean absolute contribution, each line's from the model that leaves it out; and by fold the importances and the number of trees that early stopping keeps."""
    from ptclake.operators.models import cross_validate
    from ptclake.operators.trees import contribution_sums
    from ptclake.sources.scratch import written

    li = written(_line_features(spark, sf_dir).select("id", "label", *_NUMERIC, *_CATEGORICAL), "line-features")
    cv = cross_validate(li, _NUMERIC, _CATEGORICAL, "label", "id", folds=3, patience=3, max_iter=8)
    c = contribution_sums(cv.left_out, [m.forest for m in cv.models], cv.models[0].names, by="fold")
    ranked = E.importance_rank(cv.importances.select("feature", "importance"), c)
    # a row for each fold and feature
    kept = cv.losses.filter("best").select("fold", F.col("trees").alias("kept"))
    each = F.array_sort(F.collect_list(F.struct("fold", "importance", "kept")))
    folds = cv.importances.join(kept, "fold", "left").groupBy("feature").agg(each.alias("_folds"))
    return ranked.join(folds, "feature", "left").select(*ranked.columns, F.col("_folds.importance").alias("fold_importances"), F.col("_folds.kept").alias("fold_trees"))


@query()
def cohort_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model fitted on all line items, on a cohort that lacks a column of the model: aligned, imputed, scored and put back to its ids."""
    from ptclake.operators.models import attach_ids, score_cohort, train_final
    from ptclake.sources.scratch import written

    li = written(_line_features(spark, sf_dir), "line-features")
    model = train_final(li, _NUMERIC, _CATEGORICAL, "label", id_col="id", max_iter=10)
    cohort = X.impute(X.align_columns(li.drop("l_discount"), {"l_quantity": "double", "l_discount": "double", "l_extendedprice": "double", "l_returnflag": "string", "part": "string"}, keep=["id", "label"]), _CATEGORICAL, [], _NUMERIC, {"l_quantity": 25.0, "l_discount": 0.05, "l_extendedprice": 30000.0})
    scored = score_cohort(model, cohort, "id", keep=["label"])
    return attach_ids(scored, li.select("id", "label", "l_shipdate"), "id", "label")


@query(f"WITH {SCORES} SELECT s.id, s.label, s.score, CAST(s.score >= 0.5 AS INTEGER) AS predicted_class, l.l_shipdate FROM scores s JOIN lines l ON s.id = l.id")
def attached_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores put back to the columns of their ids, one to one."""
    from ptclake.operators.models import attach_ids

    s = scores(spark, sf_dir).select("id", "label", "score", (F.col("score") >= 0.5).cast("int").alias("predicted_class"))
    return attach_ids(s, lines(spark, sf_dir).selectExpr("id", "cast(l_quantity + l_tax * 500 + l_partkey % 37 > 60 AS int) AS label", "l_shipdate"), "id", "label")


@query(
    f"""WITH {SCORES}, x AS (SELECT CASE WHEN id % 50 = 7 THEN NULL WHEN id % 10 = 3 THEN id - id % 1000 ELSE id END AS id, CASE WHEN id % 90 = 1 THEN NULL WHEN id % 70 = 2 THEN score + 1 ELSE score END AS p, score >= 0.5 AS hit FROM scores),
i AS (SELECT id, count(*) AS n FROM x GROUP BY id),
k AS (SELECT CAST(coalesce(sum(n - 1) FILTER (id IS NOT NULL), 0) AS BIGINT) AS repeated_ids, CAST(coalesce(sum(n) FILTER (id IS NULL), 0) AS BIGINT) AS null_ids FROM i)
SELECT count(*) AS n, count(*) FILTER (hit) AS n_escape, count(*) FILTER (NOT hit) AS n_nmd, any_value(repeated_ids) AS repeated_ids, any_value(null_ids) AS null_ids, count(*) FILTER (p IS NULL) AS missing, count(*) FILTER (p > 1) AS out_of_range,
min(p) AS min, quantile_cont(p, 0.25) AS p25, quantile_cont(p, 0.5) AS median, quantile_cont(p, 0.75) AS p75, max(p) AS max, round(avg(p), 8) AS mean FROM x, k"""
)
def score_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scored cohort with repeated ids, lost ids, lost scores and scores beyond 1 is reported to have."""
    from ptclake.operators.models import check_scores

    x = scores(spark, sf_dir).selectExpr("CASE WHEN id % 50 = 7 THEN NULL WHEN id % 10 = 3 THEN id - id % 1000 ELSE id END AS id", "CASE WHEN id % 90 = 1 THEN NULL WHEN id % 70 = 2 THEN score + 1 ELSE score END AS escape_probability", "cast(score >= 0.5 AS int) AS predicted_class")
    return check_scores(x, "id").withColumn("mean", F.round("mean", 8))


_MOTIFS = {"ptb": "TCTTCTT", "pum": "TGTAAATA", "are": "TATTTAT"}


def _matrix(word: str):
    import numpy as np

    return np.array([[0.85 if b == c else 0.05 for b in "ACGT"] for c in word])


def _motif_sql() -> str:
    import math

    from ptclake.operators.motifs import score_cutoff

    hit, miss = math.log2(0.85 / 0.25), math.log2(0.05 / 0.25)
    parts = []
    for name, word in _MOTIFS.items():
        k = len(word)
        same = f"len(list_filter(range(1, {k + 1}), lambda j: substr(seq, CAST(start + j - 1 AS INTEGER), 1) = substr('{word}', CAST(j AS INTEGER), 1)))"
        parts.append(f"SELECT doc_id AS id, '{name}' AS motif, start, {same} * {hit!r} + ({k} - {same}) * {miss!r} AS score, {score_cutoff(_matrix(word), 1e-3)!r} AS least FROM (SELECT doc_id, seq, unnest(range(1, {256 - k + 2})) AS start FROM seqs)")
    return f"WITH {SEQUENCES}, h AS ({' UNION ALL '.join(parts)}) SELECT id, 'utr3' AS region, motif, start, round(score, 6) AS score FROM h WHERE score >= least"


@query(_motif_sql())
def scanned_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of weight matrices in all sequences."""
    from ptclake.operators.motifs import scan_motifs

    s = sequences(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit("utr3").alias("region"), "seq")
    return _round(scan_motifs(s, {m: _matrix(w) for m, w in _MOTIFS.items()}, p=1e-3), 6)
