"""Distributed ranks, numbers, quantiles and sums against plain ones, and files in blocks."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ptclake.operators import bootstrap as B
from ptclake.operators import cohorts as C
from ptclake.operators import evaluation as E
from ptclake.operators import features as X
from ptclake.operators import models as L
from ptclake.operators import ranks
from ptclake.sources import readers as R
from ptclake.sources import writers as W


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(4)
    rows = [(k, "ab"[k % 5 == 0], rng.choice([rng.gauss(0, 1), round(rng.gauss(0, 1), 1), rng.gauss(0, 1e6)])) for k in range(3000)] + [(-1, "a", None), (-2, "a", float("nan")), (-3, "c", 5.0)]
    return rows, spark.createDataFrame(rows, "id long, g string, x double").cache()


def test_ranks_and_quantiles(values):
    rows, df = values
    by = {g: sorted(x for _, h, x in rows if h == g and x is not None and x == x) for g in "abc"}
    got = ranks.value_ranks(df, "x", ["g"]).collect()
    for r in got:
        assert r["lower"] == sum(x < r["x"] for x in by[r["g"]]) and r["ties"] == by[r["g"]].count(r["x"]) and r["total"] == len(by[r["g"]])
    assert len(got) == sum(len(set(x)) for x in by.values())
    points = [0.0, 0.1, 1 / 3, 0.5, 0.975, 1.0]
    for r in ranks.quantiles(df, "x", points, ["g"]).collect():
        assert r["q"] == pytest.approx(np.quantile(by[r["g"]], points).tolist())
    assert ranks.quantiles(df.filter("g = 'z'"), "x", points).count() == 0
    assert X.medians(df.withColumn("y", F.lit(None).cast("double")), ["x", "id", "y"]) == {"x": pytest.approx(np.median(sum(by.values(), []))), "id": 1498.0, "y": None}


def test_rank_with_ties(values):
    rows, df = values
    x = [x for _, g, x in rows if g == "b"]
    for r in E.rank_with_ties(df.filter("g = 'b'"), "x", ["g"]).collect():
        assert r["rank"] == sum(y < r["x"] for y in x) + (x.count(r["x"]) + 1) / 2


def test_folds_are_balanced_by_class(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 7 = 0 AS int) AS label")
    n = {(r["label"], r["fold"]): r["count"] for r in L.stratified_folds(df, "id", "label", 5).groupBy("label", "fold").count().collect()}
    assert len(n) == 10 and all(max(n[y, k] for k in range(5)) - min(n[y, k] for k in range(5)) <= 1 for y in (0, 1))
    again = L.stratified_folds(df.repartition(9), "id", "label", 5).collect()
    assert {(r["id"], r["fold"]) for r in again} == {(r["id"], r["fold"]) for r in L.stratified_folds(df, "id", "label", 5).collect()}


def test_fisher_equals_the_whole_sum():
    def whole(a, b, c, d):
        row, col, n = a + b, a + c, a + b + c + d
        p = [math.comb(col, x) * math.comb(n - col, row - x) for x in range(max(0, row + col - n), min(row, col) + 1)]
        seen = math.comb(col, a) * math.comb(n - col, row - a)
        return sum(x for x in p if x <= seen * (1 + 1e-7)) / math.comb(n, row)

    rng = random.Random(5)
    for _ in range(300):
        t = [rng.randint(0, rng.choice([3, 40, 300])) for _ in range(4)]
        assert E.fisher_exact(*t) == pytest.approx(whole(*t), rel=1e-6, abs=1e-300)
    assert 0 <= E.fisher_exact(30_000_000, 70_000_000, 30_010_000, 69_990_000) < 1


def test_bootstrap_is_repeatable(spark):
    df = spark.range(2000).selectExpr("id % 50 / 50 AS score", "cast((id * 7 + id % 50) % 90 > 45 AS int) AS label")
    a, b = (B.bootstrap_ci(df.repartition(k), 300).first() for k in (1, 6))
    assert a == b and a["replicates"] == 300 and a["low"] < a["median"] < a["high"]


def test_uorf_against_all_pairs(spark):
    from ptclake.functions.sequence import STOPS, has_uorf

    rng = random.Random(6)
    seqs = ["".join(rng.choice("ACGTN" if k % 9 == 0 else "ATG") for _ in range(rng.randint(0, 40))) for k in range(400)] + ["ATG" + "AAA" * 40_000 + "TAA", "ATG" + "AAA" * 40_000 + "ATAA"]
    want = [any(s[i : i + 3] == "ATG" and any(s[j : j + 3] in STOPS for j in range(i + 3, len(s) - 2, 3)) for i in range(len(s) - 2)) if len(s) < 100 else k == 400 for k, s in enumerate(seqs)]
    got = {r["id"]: r["u"] for r in spark.createDataFrame(list(enumerate(seqs)), "id long, seq string").select("id", has_uorf(F.col("seq")).alias("u")).collect()}
    assert [got[k] for k in range(len(seqs))] == want


def test_fasta_over_many_blocks(spark, tmp_path):
    rng = random.Random(7)
    want, lines = {}, []
    for name, n in (("c1", 5000), ("c2", 0), ("c3", 61), ("c4", 12_345)):
        seq = "".join(rng.choice("acgtN") for _ in range(n))
        want[name] = seq.upper()
        lines += [f">{name} some words"] + [seq[k : k + 60] for k in range(0, n, 60)]
    (tmp_path / "a.fa").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        rows = R.read_fasta(spark, str(tmp_path / "a.fa"), 1000).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in sorted(rows, key=lambda r: (r["chrom"], r["chunk_no"])):
        assert len(r["seq"]) == 1000 or r["chunk_no"] == len(want[r["chrom"]]) // 1000
        got[r["chrom"]] = got.get(r["chrom"], "") + r["seq"]
    assert got == {k: v for k, v in want.items() if v}


def test_gene_tables_tracks_and_reports(spark, tmp_path):
    (tmp_path / "g.csv").write_text("Name,Lung,Brain\nG1.5,1.5,NA\nG2,x,3\n")
    assert sorted(tuple(r) for r in R.read_gene_table(spark, str(tmp_path / "g.csv"), "Name", ["Lung", "Brain"]).collect()) == [("G1", 1.5, None), ("G2", None, 3.0)]
    (tmp_path / "t.bedgraph").write_text("chr1\t0\t5\t0.25\nchr1\t5\t5\t1\nchr2\t9\t10\t-2\n")
    assert sorted(tuple(r) for r in R.read_intervals(spark, str(tmp_path / "t.bedgraph"), value=True).collect()) == [("chr1", 1, 5, 0.25), ("chr2", 10, 10, -2.0)]
    W.write_audit_json(X.audit_columns(spark.createDataFrame([(1, None)], "a long, b string"), ["a", "z"]), str(tmp_path / "audit"))
    report = [json.loads(x) for p in (tmp_path / "audit").glob("part-*") for x in p.read_text().splitlines()]
    assert {r["feature"]: (r["status"], r["n_null"]) for r in report} == {"a": ("present", 0), "z": ("missing", 1), "b": ("extra", 1)}
    W.write_table(spark.range(5).selectExpr("id", "id % 2 AS k"), str(tmp_path / "p"), partition_by=["k"])
    assert spark.read.parquet(str(tmp_path / "p")).filter("k = 1").count() == 2
    W.write_avinput(spark.createDataFrame([("1", 5, "ACG", "T")], "chrom string, pos long, ref string, alt string"), str(tmp_path / "av"))
    assert "".join(p.read_text() for p in (tmp_path / "av").glob("part-*")) == "1\t5\t7\tACG\tT\n"


def test_columns_and_orders(spark):
    df = spark.createDataFrame([(1, "5", 2.0, "TRUE"), (2, "x", 9.0, "no"), (3, None, 4.0, None)], "id long, n string, v double, is_ptc string")
    assert [tuple(r) for r in X.align_columns(df, {"n": "double", "new": "string"}, keep=["id"]).orderBy("id").collect()] == [(1, 5.0, None), (2, None, None), (3, None, None)]
    assert [r["id"] for r in C.filter_ptc(df).collect()] == [1]
    assert [r["id"] for r in E.top_k(df, "v", 2, ["id"]).collect()] == [2, 3] and [r["id"] for r in E.sort_results(df, ["v"]).collect()] == [1, 3, 2]
    wide = df.withColumns({"b": F.lit(1), "c": F.lit(2)})
    ranking = spark.createDataFrame([("b", 0.1), ("c", 0.9), ("v", 0.5)], "feature string, importance double")
    assert X.select_top_features(wide, ranking, 2, ["id"]).columns == ["id", "c", "v"]
    with pytest.raises(ValueError, match="missing features"):
        X.select_top_features(df, ranking, 3, ["id"])
    assert X.duplicate_columns(["a", "b", "a"]) == ["a"]
