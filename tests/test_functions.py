"""Scalar functions, readers, sinks and evaluation helpers against plain values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ptclake.functions import sequence as S
from ptclake.functions import variants as V
from ptclake.operators import bootstrap as B
from ptclake.operators import cohorts as C
from ptclake.operators import correlation as K
from ptclake.operators import evaluation as E
from ptclake.operators import features as X
from ptclake.operators import motifs as M
from ptclake.sources import readers as R
from ptclake.sources import writers as W


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(
    ("last", "start", "length", "pen", "rule", "score"),
    [(True, None, None, None, "last_exon", 0.0), (False, 149, 500, True, "start_proximal", 0.12), (False, 150, 408, True, "long_exon", 0.41), (False, 150, 407, True, "50nt_rule", 0.2), (False, 150, 407, False, "trigger", 0.65), (None, 1, 1, True, None, None), (False, None, 1, True, None, None), (False, 150, None, True, None, None), (False, 150, 407, None, None, None)],
)
def test_rule_tree(spark, last, start, length, pen, rule, score):
    t = [F.lit(last).cast("boolean"), F.lit(start).cast("long"), F.lit(length).cast("long"), F.lit(pen).cast("boolean")]
    r = one(spark, V.rule_tree(*t).alias("r"))["r"]
    assert (r["rule"], r["score"]) == (rule, score)


def test_names(spark):
    r = one(spark, V.parse_variant_id(F.lit("chr1:12_A>T")).alias("a"), V.strip_version(F.lit("E.1.2")).alias("b"), V.strip_version(F.lit("E.1.2"), True).alias("c"), V.split_txnames(F.lit("A.1; B.2|C,D")).alias("d"), V.coding_pos(F.lit("c.118_120del")).alias("e"))
    assert tuple(r["a"]) == ("chr1", 12, "A", "T") and (r["b"], r["c"]) == ("E.1", "E") and r["d"] == ["A", "B", "C", "D"] and r["e"] == 118
    v3 = "AAA:ENST001.4:exon2:c.C118T:p.R40X,AAA:ENST002.8:exon3:c.C178T:p.R60X"
    got = one(spark, V.parse_annotations(F.lit(v3)).alias("a"))["a"]
    assert [(a["tx"], a["coding_pos"], a["ref"], a["alt"], a["protein_pos"]) for a in got] == [("ENST001", 118, "C", "T", 40), ("ENST002", 178, "C", "T", 60)]


def test_bins(spark):
    r = one(spark, *[V.position_bin(F.lit(x)).alias(f"p{x}") for x in (0, 100, 700, 5000)], V.aug_distance_bin(F.lit(None).cast("int")).alias("n"), V.coerce_bool(F.lit("lastexon")).alias("b"), V.assign_tier(F.lit(0.35)).alias("t"), V.label_escape(F.lit(0.65)).alias("e"), V.label_escape(F.lit(0.2)).alias("f"))
    assert tuple(r) == ("0-100", "100-200", "700+", "700+", "no_inframe_AUG", True, "Ambiguous", True, None)


def test_distances(spark):
    r = one(spark, V.ptc_distances(F.lit(150), F.array(*map(F.lit, (100, 200, 400)))).alias("d"), V.ptc_distances(F.lit(100), F.array(*map(F.lit, (100, 200)))).alias("e"), V.ptc_distances(F.lit(401), F.array(F.lit(400))).alias("f"))
    d = r["d"]
    assert (d["mut_exon"], d["exon_length"], d["to_exon_end"], d["penultimate_last50"], d["exons_after"]) == (2, 100, 50, True, 1)
    assert r["e"]["mut_exon"] == 1 and r["f"]["mut_exon"] is None


def test_sequences(spark):
    assert len(S.CODONS) == 64 and S.CODONS["ATG"] == "M" and S.CODONS["TGG"] == "W" and [c for c, a in S.CODONS.items() if a == "*"] == ["TAA", "TAG", "TGA"]
    cds = "ATGGGGCGAGGTTGGTAA" + "CATGCC"
    c = F.lit(cds)
    r = one(spark, S.ptc_amino_acids(c, F.lit(3)).alias("a"), S.readthrough_context(c, F.lit(7), F.lit("C"), F.lit("T")).alias("x"), S.codons(F.lit("ATGAA")).alias("k"), S.downstream_augs(c, F.lit(4)).alias("d"), S.has_uorf(F.lit("CATGAAATAACC")).alias("u"), S.has_uorf(F.lit("CATGAATAACC")).alias("v"))
    assert r["a"]["minus2"] == "M" and r["a"]["minus1_gly"] and r["a"]["plus1"] == "G" and r["a"]["plus2"] == "W"
    assert r["x"] == "GGGTGAGGTTGG" and r["k"] == ["ATG"] and r["u"] and not r["v"]
    assert r["d"]["inframe"] is None and r["d"]["plus1_distance"] == 16


def _auc(y, s):
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))


def test_metrics(spark):
    rng = np.random.default_rng(1)
    s = np.round(rng.random(400) * np.where(rng.random(400) < 0.1, 3, 1), 2)
    y = (rng.random(400) < np.clip(s, 0, 1)).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y, strict=True))], "id long, score double, label int")
    t = E.score_table(df)
    assert E.roc_pr(t).first()["roc_auc"] == pytest.approx(_auc(y, s))
    tp = sorted(t.collect(), key=lambda r: -r["score"])
    assert [r["tp0"] for r in tp] == [int(((s > r["score"]) & (y == 1)).sum()) for r in tp]
    b = B.bootstrap_ci(df, 200).first()
    assert b["low"] < _auc(y, s) < b["high"]


def test_golden_confusion(spark):
    r = one(spark, *E.rates(*[F.lit(x) for x in (1558, 698, 2433, 1060)]))
    assert round(r["balanced_accuracy"], 3) == 0.686


def test_fisher_and_bh(spark):
    assert E.fisher_exact(8, 2, 1, 5) == pytest.approx(0.03496503496503495)
    assert E.fisher_exact(0, 0, 3, 4) == pytest.approx(1.0)
    q = E.bh_adjust(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,), (None,)], "p_value double")).collect()
    assert {r["p_value"]: r["q_value"] and round(r["q_value"], 6) for r in q} == {0.01: 0.04, 0.03: 0.053333, 0.04: 0.053333, 0.5: 0.5, None: None}


def test_rank_sum(spark):
    rng = random.Random(3)
    rows = [("m", i % 2, float(rng.randint(0, 9) + i % 2)) for i in range(60)]
    r = E.motif_effect(spark.createDataFrame(rows, "motif string, present int, value double")).first()
    values = [v for _, _, v in rows]
    rank = {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in values}
    u = sum(rank[v] for _, p, v in rows if p) - 30 * 31 / 2 - 450
    tie = sum(values.count(v) ** 2 - 1 for v in values)
    z = (abs(u) - 0.5) / math.sqrt(900 / 12 * (61 - tie / (60 * 59)))
    assert r["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=2e-7)


def test_prune():
    corr = {("a", "b"): 0.99, ("a", "c"): 0.99, ("b", "c"): 0.5, ("a", "r"): 0.97, ("r", "s"): 0.99}
    assert K.correlation_prune(["a", "b", "c", "r", "s"], corr, {"r", "s"}) == ["b", "c", "a"]


def test_features(spark):
    df = spark.createDataFrame([(1, 1.0, None, "x", 0), (2, 3.0, 5.0, None, 1), (3, None, 7.0, "y", 1)], "id long, a double, b double, c string, d int")
    assert X.categorical_columns(df, []) == ["c", "d"]
    out = {r["id"]: r for r in X.impute(df, ["c"], ["b"], ["a", "b"]).collect()}
    assert out[3]["a"] == 2.0 and out[1]["b"] == 0.0 and out[2]["c"] == "MISSING"
    audit = {r["feature"]: (r["status"], r["n_null"]) for r in X.audit_columns(df, ["a", "z"]).collect()}
    assert audit["a"] == ("present", 1) and audit["z"] == ("missing", 3) and audit["b"] == ("extra", 1)
    assert one(spark, F.lit(1.0).alias("p"), F.lit(None).cast("double").alias("q"), F.lit(4.0).alias("r")) and df.select(X.row_median(["a", "b"]).alias("m")).collect()[1]["m"] == 4.0
    with pytest.raises(Exception, match="repeated key"):
        X.join_predictions(df.union(df), df, "id").collect()
    assert X.resolve_columns(df, {"n": ["zz", "b"]}) == {"n": "b"}


def test_cohort_joins(spark):
    v = spark.createDataFrame([(1, "T1.1;T2.3", "G:T2.3:e1:c.C5T:p.R2X,G:T9:e1:c.C5T:p.R2X"), (2, "T1", None)], "id long, txnames string, v3 string")
    ctx = spark.createDataFrame([(1, "T1", "x"), (1, "T2", "y")], "id long, tx string, context string")
    assert [tuple(r) for r in C.strict_tx_match(v, ctx).collect()] == [(1, "T2", "y")]
    can = spark.createDataFrame([("G", "T2.9")], "gene string, canonical_tx string")
    assert [r["coding_pos"] for r in C.canonical_by_gene(v, can).collect()] == [5]
    assert sorted(str(r["tx"]) for r in C.explode_txnames(v.select("id", F.when(F.col("id") == 1, F.col("txnames")).alias("txnames"))).collect()) == ["None", "T1", "T2"]


def test_files(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#x\nchr1\ts\texon\t10\t20\t.\t+\t.\tgene_id "G.1"; transcript_id "T.2"; exon_number 3; tag "basic"; tag "appris_principal_1"; tag "MANE_Select"; transcript_support_level "1 (x)";\nchr1\ts\tgene\t1\t9\t.\t+\t.\tgene_id "G.1";\n')
    g = R.read_gtf(spark, str(tmp_path / "a.gtf")).collect()
    assert [(r["tx"], r["gene"], r["exon_number"], r["mane"], r["appris"], r["tsl"]) for r in g] == [("T.2", "G.1", 3, 1, 1, 1)]
    (tmp_path / "a.fa").write_text(">c1 desc\nacgt\nAC\n>c2\nGGG\n")
    assert sorted((r["chrom"], r["chunk_no"], r["seq"]) for r in R.read_fasta(spark, str(tmp_path / "a.fa"), 4).collect()) == [("c1", 0, "ACGT"), ("c1", 1, "AC"), ("c2", 0, "GGG")]
    (tmp_path / "a.bed").write_text("#t\nchr1\t0\t5\tx\nchr1\t7\t7\ty\n")
    assert [tuple(r) for r in R.read_intervals(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 1, 5)]
    (tmp_path / "a.tsv").write_text("k\tv\na\t1\nb\tNA\n")
    assert [tuple(r) for r in R.read_table(spark, str(tmp_path / "a.tsv")).collect()] == [("a", "1"), ("b", None)]
    (tmp_path / "g.tsv").write_text("chrom\tpos\ts1\ts2\nc\t1\t0/1\t0/0\n")
    assert sorted(r["sample"] for r in C.filter_het(R.read_genotypes(spark, str(tmp_path / "g.tsv"))).collect()) == ["s1"]
    (tmp_path / "a.vcf").write_text("##h\nc\t1\t.\tA\tT\t.\tPASS\tDP=3;ANN=T|stop_gained|HIGH\n")
    sites = R.read_vcf_sites(spark, str(tmp_path / "a.vcf"))
    assert C.filter_consequence(sites).count() == 1
    W.write_vcf(sites, str(tmp_path / "out"))
    assert R.read_table(spark, str(tmp_path / "out"), sep="\t").first()["ALT"] == "T"
    W.write_table(sites, str(tmp_path / "p"), "tsv", ["chrom"])
    W.write_avinput(sites, str(tmp_path / "av"))
    W.write_fasta_batches(spark.createDataFrame([(0, "r", "AC"), (1500, "r", "GT"), (2, "r", "")], "i long, region string, seq string"), str(tmp_path / "fa"))
    assert sorted(p.name for p in (tmp_path / "fa" / "region=r").iterdir()) == ["batch=0", "batch=1"]
    (tmp_path / "an.txt").write_text("l1\tstopgain\tx\tchr1\t5\t5\tA\tT\n")
    assert R.read_annovar(spark, str(tmp_path / "an.txt")).first()["key"] == "chr1:5_A>T"


def test_motifs(spark):
    pwm = np.array([[0.97 if b == c else 0.01 for b in "ACGT"] for c in "TGTAAATA"])
    s = spark.createDataFrame([(1, "u", "CCTGTAAATACC"), (2, "u", "CCTGTNAATACC"), (3, "u", None)], "id long, region string, seq string")
    hits = M.scan_motifs(s, {"pum:1": pwm}, p=1e-4)
    assert [(r["id"], r["start"]) for r in hits.collect()] == [(1, 3)]
    m = M.motif_matrix(M.motif_presence(hits, spark.createDataFrame([("pum", "PUM2")], "motif string, gene string")), s, ["u.PUM2"])
    assert {r["id"]: r[1] for r in m.collect()} == {1: 1, 2: 0, 3: 0}


def test_models(spark):
    from ptclake.operators import models as L

    df = spark.createDataFrame([(i, float(i % 17), "ab"[i % 2], int(i % 17 > 8)) for i in range(120)], "id long, x double, c string, label int")
    oof = L.train_oof(df, ["x"], ["c"], "label", "id", max_iter=3).cache()
    assert oof.count() == 120 and E.roc_pr(E.score_table(oof)).first()["roc_auc"] > 0.95
    assert E.fold_summary(oof, "fold").first()["oof_auc"] > 0.95
    assert L.isotonic_recalibrate(oof).filter("calibrated IS NULL").count() == 0
    scored = L.score_cohort(L.train_final(df, ["x"], ["c"], "label", max_iter=3), df, "id")
    assert L.attach_ids(scored.withColumn("label", F.col("predicted_class")), scored.select("id", F.col("predicted_class").alias("label"), F.lit(1).alias("k")), "id", "label").count() == 120


def test_codons_of_a_transcript_on_another_chromosome(spark):
    cds, at = F.lit("ATGGCCAAATAA"), F.lit(4)
    status = lambda same: one(spark, S.codon_optimality(cds, at, ["GCC"], same_chrom=same).alias("s"))["s"]
    assert status(F.lit(True))["status"] == "ok" and status(F.lit(True))["whole"] == 0.25
    gone = status(F.lit(False))
    assert gone["status"] == "chr_mismatch" and gone["whole"] is None and gone["window"] is None
    assert status(F.lit(None).cast("boolean"))["status"] == "ok" and status(None)["status"] == "ok"
