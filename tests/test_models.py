"""Target statistics, trees as arrays, early stopping, contributions, one-to-one ids and checks of scores."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ptclake.operators import encoding, trees
from ptclake.operators import evaluation as E
from ptclake.operators import models as L


def test_ordered_statistics_are_running_shares(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["hot"] * 5 + ["a", "b", None, ""]), rng.randrange(90), rng.choice([0, 1, 1, None])) for k in range(1500)]
    df = spark.createDataFrame(rows, "id long, c string, `d.e` int, y int")
    order = sorted(rows, key=lambda r: hashlib.md5(f"42:{r[0]}".encode()).hexdigest())
    want = {}
    for at in (1, 2):
        seen = {}
        for r in order:
            s, n = seen.get(r[at], (0, 0))
            want[r[0], at] = (s + 0.5) / (n + 1)
            seen[r[at]] = (s + (r[3] or 0), n + (r[3] is not None))
    for parts in (1, 6):
        got = encoding.ordered_statistics(df.repartition(parts), ["c", "d.e"], "y", "id").collect()
        assert len(got) == 1500 and all(r["c_statistic"] == pytest.approx(want[r["id"], 1]) and r["d.e_statistic"] == pytest.approx(want[r["id"], 2]) for r in got)
    whole = encoding.category_statistics(df, ["c"], "y")
    n = sum(r[1] is None and r[3] is not None for r in rows)
    assert {r["category"]: r["statistic"] for r in whole.collect()}[None] == pytest.approx((sum(r[1] is None and r[3] == 1 for r in rows) + 0.5) / (n + 1))
    new = spark.createDataFrame([(1, "hot"), (1, "hot"), (2, "never"), (3, None)], "id long, c string")
    applied = encoding.apply_statistics(new, ["c"], whole).collect()
    assert len(applied) == 4 and {r["c_statistic"] for r in applied if r["id"] == 2} == {0.5}
    assert encoding.ordered_statistics(df.limit(0), ["c"], "y", "id").count() == 0


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(4)
    rows = [(k, rng.random(), 0.5 if k % 9 == 0 else rng.random(), rng.choice("abcdef"), rng.random()) for k in range(800)]
    df = spark.createDataFrame([(*r, int(r[1] + r[2] * (r[3] in "abc") + 0.2 * rng.random() > 0.8)) for r in rows], "id long, x double, y double, c string, z double, label int")
    indexed = StringIndexer(inputCol="c", outputCol="k").fit(df).transform(df)
    data = VectorAssembler(inputCols=["x", "y", "k", "z"], outputCol="_features", handleInvalid="keep").transform(indexed).cache()
    model = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=12, maxDepth=4, seed=1).fit(data)
    return model, trees.forest_of(model), data


def test_arrays_score_as_the_model_does(fitted):
    model, forest, data = fitted
    assert forest.lefts
    rows = trees.forest_scores(model.transform(data), forest).select(vector_to_array("probability")[1].alias("p"), "score", vector_to_array("_features").alias("x")).collect()
    assert [r["score"] for r in rows] == pytest.approx([r["p"] for r in rows], abs=1e-12)
    assert forest.importances(4) == pytest.approx(model.featureImportances.toArray(), abs=1e-9)
    x = np.array([r["x"] for r in rows])
    missing = np.where(np.arange(4) == 1, np.nan, x)
    assert (forest.values(missing) == forest.values(np.where(np.isnan(missing), 2.0, missing))).all()
    assert forest.first(5).values(x) == pytest.approx(forest.values(x)[:, :5])


def test_losses_are_those_of_each_prefix(fitted):
    model, forest, data = fitted
    got = {r["trees"]: r["log_loss"] for r in trees.staged_losses(data, forest, "label").collect()}
    for n in range(1, 13):
        scored = trees.forest_scores(data, forest.first(n))
        assert got[n] == pytest.approx(E.brier_log_loss(scored).first()["log_loss"], abs=1e-9)
    assert trees.best_trees([5, 4, 3, 3, 3.5, 2], 2) == 3 and trees.best_trees([5, 4, 3, 3, 3.5, 2], 3) == 6 and trees.best_trees([1], 5) == 1


def test_contributions_are_shapley_values(fitted):
    _, forest, data = fitted
    small = forest.first(3)
    rows = data.limit(25).cache()
    x = np.array([r[0] for r in rows.select(vector_to_array("_features")).collect()])

    def known(node, row, features):
        f = small.feature[node]
        if f < 0:
            return small.value[node]
        ways = small.left[node], small.right[node]
        if f in features:
            return known(ways[0] if small.goes_left(node, row[None, :])[0] else ways[1], row, features)
        return sum(small.cover[w] / small.cover[node] * known(w, row, features) for w in ways)

    margin = lambda row, features: sum(known(r, row, features) for r in small.roots.tolist())
    got = small.contributions(x)
    for row, values in zip(x, got, strict=True):
        for f in range(4):
            others = [g for g in range(4) if g != f]
            want = sum(math.factorial(k) * math.factorial(3 - k) / 24 * (margin(row, {*s, f}) - margin(row, set(s))) for k in range(4) for s in itertools.combinations(others, k))
            assert values[f] == pytest.approx(want, abs=1e-12)
    assert small.base == pytest.approx(margin(x[0], set()))
    long = trees.contributions(data, forest, ["x", "y", "k", "z"], "id").groupBy("id").agg(F.sum("contribution").alias("c"), F.first("base").alias("b"), F.count("*").alias("n"))
    scored = {r["id"]: math.log(r["score"] / (1 - r["score"])) / 2 for r in trees.forest_scores(data, forest).collect()}
    assert all(r["n"] == 4 and r["c"] + r["b"] == pytest.approx(scored[r["id"]], abs=1e-9) for r in long.collect())


def test_a_leaf_behind_too_many_features_is_refused():
    n = trees.DEEPEST + 1
    feature, left, right = [*range(n), *[-1] * (n + 1)], [*range(n, 2 * n), *[-1] * (n + 1)], [*range(1, n), 2 * n, *[-1] * (n + 1)]
    deep = trees.Forest(np.array(feature), np.zeros(2 * n + 1), np.array(left), np.array(right), np.ones(2 * n + 1), np.ones(2 * n + 1), np.ones(2 * n + 1), {}, np.array([0]))
    with pytest.raises(ValueError, match="at most"):
        _ = deep.leaves


def test_cross_validation_with_ten_thousand_categories(spark, tmp_path):
    df = spark.range(0, 60_000, 1, 4).selectExpr("id", "xxhash64(id) % 1000 / 1000 AS x", "cast(pmod(xxhash64(id, 1), 10000) AS string) AS c").selectExpr("*", "CASE WHEN id % 500 = 0 THEN NULL ELSE cast(pmod(xxhash64(c), 100) / 100 + 0.2 * x > 0.5 AS int) END AS label")
    cv = L.cross_validate(df, ["x"], ["c"], "label", "id", folds=2, patience=2, max_iter=4, max_depth=3)
    assert cv.scores.count() == 60_000 and cv.scores.filter("label IS NULL").count() == 120
    assert E.roc_pr(E.score_table(cv.scores)).first()["roc_auc"] > 0.7
    best = {r["fold"]: r["trees"] for r in cv.losses.filter("best").collect()}
    assert best == {k: len(m.forest.roots) for k, m in enumerate(cv.models)}
    assert {r["feature"] for r in cv.importances.collect()} == {"x", "c"} and cv.importances.agg(F.sum("importance")).first()[0] == pytest.approx(2)
    cv.models[0].save(str(tmp_path / "m"))
    again = L.Trained.load(spark, str(tmp_path / "m"))
    few = df.filter("id < 200")
    assert sorted(map(tuple, again.scored(few).select("id", "score").collect())) == sorted(map(tuple, cv.models[0].scored(few).select("id", "score").collect()))


def test_ids_go_one_to_one(spark):
    p = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.9)], "id long, label int, score double")
    ids = p.select("id", "label", F.lit("v").alias("name"))
    assert sorted(map(tuple, L.attach_ids(p, ids, "id", "label").collect())) == [(1, 0, 0.1, "v"), (2, 1, 0.9, "v")]
    bad = {"repeated id of the predictions": (p.union(p), ids), "repeated id of the ids": (p, ids.union(ids)), "no partner": (p.filter("id = 1"), ids), "labels differ": (p, ids.withColumn("label", F.lit(1)))}
    for words, (a, b) in bad.items():
        with pytest.raises(Exception, match=words):
            L.attach_ids(a, b, "id", "label").collect()


def test_checks_of_scores(spark):
    df = spark.createDataFrame([(1, 0.25, 0), (1, 0.75, 1), (2, None, None), (None, float("nan"), 0), (3, 1.5, 1)], "id long, escape_probability double, predicted_class int")
    r = L.check_scores(df, "id").first().asDict()
    assert r == {"n": 5, "n_escape": 2, "n_nmd": 2, "repeated_ids": 1, "null_ids": 1, "missing": 2, "out_of_range": 1, "min": 0.25, "p25": 0.5, "median": 0.75, "p75": 1.125, "max": 1.5, "mean": pytest.approx(2.5 / 3)}
    assert L.check_scores(df.limit(0), "id").first()["n"] == 0


def test_recalibration_only_beyond_the_limit(spark):
    rows = [(k, k % 5, int(k % 10 < 5), 0.5) for k in range(200)]
    oof = spark.createDataFrame(rows, "id long, fold int, label int, score double")
    assert L.isotonic_recalibrate(oof, limit=0.03).filter("calibrated <> score").count() == 0
    off = oof.withColumn("score", F.lit(0.9))
    assert {round(r["calibrated"], 6) for r in L.isotonic_recalibrate(off, limit=0.03).collect()} == {0.5}


def test_statistics_of_left_out_folds_with_common_categories(spark, monkeypatch):
    """Each fold's model has what a pass over its own rows gives, also where categories go by parts."""
    rng = random.Random(2)
    rows = [(k, rng.choice(["hot"] * 6 + [None, "a"]), rng.randrange(60), rng.choice([0, 1, 1, None]), k % 3) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, c string, d int, y int, fold int")
    for many in (encoding.MANY, 40):
        monkeypatch.setattr(encoding, "MANY", many)
        got = {r["id"]: r for r in encoding.ordered_statistics(df, ["c", "d"], "y", "id", fold="fold", folds=3).collect()}
        for k in range(3):
            alone = {r["id"]: r for r in encoding.ordered_statistics(df.filter(F.col("fold") != k), ["c", "d"], "y", "id").collect()}
            whole = encoding.category_statistics(df.filter(F.col("fold") != k), ["c", "d"], "y")
            applied = {r["id"]: r for r in encoding.apply_statistics(df.filter(F.col("fold") == k), ["c", "d"], whole).collect()}
            for name in ("c_statistic", "d_statistic"):
                assert all(got[i][name][k] == pytest.approx(r[name]) for i, r in (alone | applied).items())
        assert len(got) == 900


def test_statistics_shuffle_rows_once_a_column(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 7 AS string) AS c", "cast(id % 90 AS string) AS d", "cast(id % 3 = 0 AS int) AS y")
    plan = encoding.ordered_statistics(df, ["c", "d"], "y", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and "Join" not in plan


def test_ids_are_attached_without_an_aggregate_of_rows(spark):
    p = spark.range(50).selectExpr("id", "cast(id % 2 AS int) AS label", "0.5D AS score")
    plan = L.attach_ids(p, p.select("id", "label", F.lit("v").alias("name")), "id", "label")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_kept_columns_of_a_scored_cohort(spark):
    df = spark.range(60).selectExpr("id", "id % 7 / 7 AS x", "cast(id % 7 > 3 AS int) AS label")
    scored = L.score_cohort(L.train_final(df, ["x"], [], "label", max_iter=2), df, "id", keep=["label"]).collect()
    assert len(scored) == 60 and all(r["label"] == int(r["id"] % 7 > 3) for r in scored)
