"""Boosted trees from sums over blocks, and what the model queries make of them."""

import random

import numpy as np
import pytest
from helpers import SF
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ptclake.operators import boosting, trees
from ptclake.operators import models as L
from ptclake.plans.queries import QUERIES


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    made = [(k, rng.randrange(40) / 7, rng.randrange(60) * 1.3, float(rng.randrange(9)), k % 3) for k in range(3000)]
    path = f"{spark.conf.get('spark.checkpoint.dir')}/boosting-rows"
    spark.createDataFrame([(*r, int(r[1] / 6 + r[2] / 70 + r[3] / 9 * rng.random() > 1.3)) for r in made], "id long, x double, y double, z double, fold int, label int").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_trees_are_those_of_pyspark_ml(spark, rows):
    """Where every value has a bin, nodes and scores are the library's."""
    data = VectorAssembler(inputCols=["x", "y", "z"], outputCol="_features").transform(rows)
    want = trees.forest_of(GBTClassifier(featuresCol="_features", labelCol="label", maxIter=4, maxDepth=4, maxBins=64, seed=1).fit(data))
    got = boosting.packed(rows, ["x", "y", "z"], [[0, 1, 2]], "label").grown(4, 4)[0]
    assert got.feature.tolist() == want.feature.tolist() and got.cover.tolist() == want.cover.tolist() and got.roots.tolist() == want.roots.tolist()
    assert got.importances(3) == pytest.approx(want.importances(3), abs=1e-6)
    a, b = ({r["id"]: r["score"] for r in trees.forest_scores(data, f).collect()} for f in (got, want))
    assert len(a) == 3000 and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in b)
    again = trees.table_forest(trees.forest_table(spark, got))
    assert all(np.array_equal(getattr(again, k), getattr(got, k), equal_nan=True) for k in ("feature", "threshold", "left", "right", "value", "cover", "gain", "roots"))


def test_folds_grow_in_the_same_passes(spark, rows, monkeypatch):
    """A model of several is the one that its rows alone give; passes don't grow with folds, nor trees with blocks or partitions."""
    passes = []
    monkeypatch.setattr(boosting.Packed, "_sums", lambda self, *a, own=boosting.Packed._sums: passes.append(1) or own(self, *a))
    got = boosting.packed(rows, ["x", "y", "z"], [[0, 1, 2]] * 3, "label", "fold").grown(2, 3)
    assert len(passes) == 6
    monkeypatch.setattr(boosting, "BLOCK", 100)
    for k, forest in enumerate(got):
        alone = boosting.packed(rows.filter(F.col("fold") != k).repartition(3), ["x", "y", "z"], [[0, 1, 2]], "label").grown(2, 3)[0]
        assert all(np.array_equal(getattr(alone, c), getattr(forest, c), equal_nan=True) for c in ("feature", "threshold", "value", "cover"))


def test_losses_of_left_out_rows(spark, rows):
    blocks = boosting.packed(rows, ["x", "y", "z"], [[0, 1, 2]] * 3, "label", "fold")
    forests = blocks.grown(3, 2)
    data = VectorAssembler(inputCols=["x", "y", "z"], outputCol="_features").transform(rows)
    for k, losses in enumerate(blocks.losses(forests)):
        want = {r["trees"]: r["log_loss"] for r in trees.staged_losses(data.filter(F.col("fold") == k), forests[k], "label").collect()}
        assert losses == pytest.approx([want[t] for t in (1, 2, 3)], abs=1e-6)


def test_rare_values_have_cuts_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(boosting, "POINTS", 300)
    df = spark.range(0, 5000, 1, 2).selectExpr("CASE WHEN id % 100 = 1 THEN id % 40 ELSE 0.0D END AS a", "cast(id AS double) AS b", "CASE WHEN id % 9 = 0 THEN NULL ELSE cast('NaN' AS double) END AS c")
    a, b, c = boosting.bin_cuts(df, ["a", "b", "c"])
    assert a.tolist() == sorted({float(k % 40) for k in range(1, 5000, 100)} | {0.0})[:-1] and len(c) == 0
    assert len(b) == 63 and np.abs(np.diff(b, prepend=0, append=5000) - 5000 / 64).max() < 5000 / 64 / 2


def test_contributions_come_from_all_folds_models(spark):
    """Each line's from the model that leaves it out; the result says each fold's importances and trees."""
    df = spark.range(0, 900).selectExpr("id", "pmod(xxhash64(id), 100) / 100 AS x", "cast(pmod(xxhash64(id, 1), 5) AS string) AS c").withColumn("label", F.expr("cast(x + cast(c AS int) / 10 > 0.7 AS int)"))
    cv = L.cross_validate(df, ["x"], ["c"], "label", "id", folds=3, patience=2, max_iter=3, max_depth=2)
    forests = [m.forest for m in cv.models]
    sums = trees.contributions(cv.left_out, forests, ["x", "c"], "id", by="fold").groupBy("id").agg((F.sum("contribution") + F.first("base")).alias("margin")).collect()
    scores = {r["id"]: r["score"] for r in cv.scores.collect()}
    assert len(sums) == 900 and all(1 / (1 + np.exp(-2 * r["margin"])) == pytest.approx(scores[r["id"]]) for r in sums)
    # sums in the tasks are those of the rows
    rows = trees.contributions(cv.left_out, forests, ["x", "c"], "id", by="fold").groupBy("feature").agg(F.sum(F.abs("contribution")).alias("total"), F.count("*").alias("n"))
    added = trees.contribution_sums(cv.left_out, forests, ["x", "c"], by="fold").groupBy("feature").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    want, sums = ({r["feature"]: (r["n"], r["total"]) for r in d.collect()} for d in (rows, added))
    assert want.keys() == sums.keys() and all(sums[f] == pytest.approx(want[f]) for f in want)
    got = QUERIES["fold_importances"](spark, SF).collect()
    assert len(got) == 5 and all(len(r["fold_importances"]) == len(r["fold_trees"]) == 3 and min(r["fold_trees"]) >= 1 for r in got)
    assert all(np.mean(r["fold_importances"]) == pytest.approx(r["mean_importance"]) for r in got)


def test_a_final_model_reads_sorted_statistics_once(spark, monkeypatch):
    """Passes read packed rows; statistics in the order of a permutation are worked out for the written table only."""
    names = []
    for module in (L, boosting):
        monkeypatch.setattr(module, "written", lambda df, name, own=module.written: names.append(name) or own(df, name))
    df = spark.range(0, 400).selectExpr("id", "id % 7 / 7 AS x", "cast(id % 5 AS string) AS c", "cast(id % 7 > 3 AS int) AS label")
    model = L.train_final(df, ["x"], ["c"], "label", id_col="id", max_iter=1, max_depth=2)
    assert names[-2:] == ["encoded", "blocks"]
    assert all((r["score"] > 0.5) == (r["label"] == 1) for r in model.scored(df).collect())
