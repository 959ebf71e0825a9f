"""Model jobs: stratified folds, out-of-fold training, final training, scoring and its checks, recalibration.

Categories go in as target statistics (``encoding``), so a column may have any number of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ptclake.operators.boosting import packed
from ptclake.operators.encoding import apply_statistics, category_statistics, ordered_statistics, statistic_name
from ptclake.operators.evaluation import calibration, calibration_errors
from ptclake.operators.features import fold_medians
from ptclake.operators.ranks import numbered, quantiles
from ptclake.operators.trees import Forest, best_trees, forest_scores, forest_table, table_forest
from ptclake.sources.scratch import written


def stratified_folds(df: DataFrame, id_col: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Class-balanced folds: rows of a label in the order of an MD5 of seed and id, dealt in turn. Digests are sorted by their first three digits, so a class is no task.

    Rows without a label are a class of their own; rows without an id stand where the empty id does.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    n = numbered(df, [label], [order, id_col], F.substring(order, 1, 3), "fold", classes=True)
    return n.withColumn("fold", (F.col("fold") % folds).cast("int"))


def _assembled(columns: list[Column]) -> Column:
    """The values of the trees' features; missing ones are NaN."""
    return F.array(*[F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in columns])


@dataclass
class Trained:
    """A fitted ensemble: its trees, its columns, and the statistics of its categories (None without any)."""

    forest: Forest
    numeric: list[str]
    categorical: list[str]
    statistics: DataFrame | None

    @property
    def names(self) -> list[str]:
        """The features as the trees number them, categories by their own names."""
        return [*self.numeric, *self.categorical]

    def features(self, df: DataFrame) -> DataFrame:
        """Rows with ``_features``."""
        encoded = apply_statistics(df, self.categorical, self.statistics) if self.categorical else df
        return encoded.withColumn("_features", _assembled([F.col(f"`{c}`") for c in [*self.numeric, *map(statistic_name, self.categorical)]]))

    def scored(self, df: DataFrame) -> DataFrame:
        """Rows with ``score``, the probability of label 1."""
        return forest_scores(self.features(df), self.forest).drop("_features", *map(statistic_name, self.categorical))

    def save(self, path: str) -> None:
        spark = SparkSession.builder.getOrCreate()
        forest_table(spark, self.forest).write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(self.numeric, self.categorical)], "numeric array<string>, categorical array<string>").write.mode("overwrite").json(f"{path}/columns")
        if self.categorical:
            self.statistics.write.mode("overwrite").parquet(f"{path}/statistics")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Trained:
        r = spark.read.schema("numeric array<string>, categorical array<string>").json(f"{path}/columns").first()
        return Trained(table_forest(spark.read.parquet(f"{path}/trees")), list(r["numeric"]), list(r["categorical"]), spark.read.parquet(f"{path}/statistics") if r["categorical"] else None)


def _fit(df: DataFrame, numeric: list[str], categorical: list[str], label: str, id_col: str | None, **options) -> Trained:
    """Fits on the rows that have a label; numeric columns must have values there (``impute``), categories by ordered statistics where there is an id to order by."""
    known = df.filter(F.col(label).isNotNull()).select(*dict.fromkeys([*([id_col] if id_col else []), *(f"`{c}`" for c in [*numeric, *categorical]), label]))
    statistics = None
    if categorical:
        statistics = written(category_statistics(known, categorical, label), "category-statistics")
        known = ordered_statistics(known, categorical, label, id_col) if id_col else apply_statistics(known, categorical, statistics)
    features = [*numeric, *map(statistic_name, categorical)]
    blocks = packed(written(known.select(*[f"`{c}`" for c in features], label), "encoded"), features, [list(range(len(features)))], label)
    return Trained(blocks.grown(**options)[0], numeric, categorical, statistics)


@dataclass
class CrossValidation:
    """Of all folds: out-of-fold scores (id, fold, label, score), losses by number of trees (fold, trees, log_loss, best), importances (fold, feature, importance) and the rows with ``_features`` as the model that leaves them out has them."""

    scores: DataFrame
    losses: DataFrame
    importances: DataFrame
    models: list[Trained]
    left_out: DataFrame


def cross_validate(df: DataFrame, numeric: list[str], categorical: list[str], label: str, id_col: str, folds: int = 5, patience: int | None = None, fill: bool = False, losses_too: bool = True, **options) -> CrossValidation:
    """Trains on all folds but one and scores that one. With ``fill``, missing numeric values are the medians of the folds that a model is trained on. With ``patience`` (early stopping), only the first trees count up to the least loss on the left-out fold.

    The left-out fold chooses the number of trees as well as being scored, as in the source; a score that no choice has seen needs a further split.
    Folds, with categories' statistics for the models of all folds from one pass, and scores are written, so nothing is worked out twice. Rows
    without a label are scored and never trained on. Losses (left out with ``losses_too`` false and no ``patience``) and importances are a row for each tree and each feature of a model.
    """
    spark = df.sparkSession
    own = df.select(*dict.fromkeys([id_col, *(f"`{c}`" for c in [*numeric, *categorical]), label]))
    data = stratified_folds(own, id_col, label, folds)
    data = written(ordered_statistics(data, categorical, label, id_col, fold="fold", folds=folds) if categorical else data, "folds")
    medians = {(r["feature"], r["fold"]): r["median"] for r in fold_medians(data, numeric, "fold", folds).collect()} if fill else {}  # a number for each column and fold
    number = lambda c: F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan")))
    filled = lambda c, k: F.coalesce(number(c), F.lit(medians.get((c, k), None)).cast("double")) if fill else F.col(f"`{c}`").cast("double")
    feature = lambda c, k: F.get(F.col(f"`{statistic_name(c)}`"), F.lit(k)) if c in categorical else filled(c, k)
    shared = [] if fill else numeric  # columns that are the same for all models
    names = [*numeric, *categorical]
    columns = {f"_x{i}": feature(c, 0) for i, c in enumerate(shared)} | {f"_x{len(shared) + k * (len(names) - len(shared)) + i}": feature(c, k) for k in range(folds) for i, c in enumerate(names[len(shared) :])}
    places = [[*range(len(shared)), *range(len(shared) + k * (len(names) - len(shared)), len(shared) + (k + 1) * (len(names) - len(shared)))] for k in range(folds)]
    blocks = packed(data.select("fold", label, *[x.alias(n) for n, x in columns.items()]), list(columns), places, label, "fold")
    forests = blocks.grown(**options)
    by_trees = blocks.losses(forests) if losses_too or patience else [[]] * folds
    losses, importances, models = [], [], []
    for k, forest in enumerate(forests):
        best = best_trees(by_trees[k], patience) if patience and by_trees[k] else len(forest.roots)
        forests[k] = forest.first(best)
        statistics = category_statistics(data.filter((F.col("fold") != k) & F.col(label).isNotNull()), categorical, label) if categorical else None  # worked out where other rows are scored
        losses += [(k, t, loss, t == best) for t, loss in enumerate(by_trees[k], 1)]
        importances += [(k, c, float(x)) for c, x in zip(names, forests[k].importances(len(names)), strict=True)]
        models.append(Trained(forests[k], numeric, categorical, statistics))
    left_out = data.select(id_col, "fold", F.col(label).alias("label"), _assembled([reduce(lambda x, k: F.when(F.col("fold") == k, feature(c, k)).otherwise(x), range(1, folds), feature(c, 0)) for c in names]).alias("_features"))  # noqa: B023
    scores = written(forest_scores(left_out, forests, by="fold").select(id_col, "fold", "label", "score"), "out-of-fold")
    return CrossValidation(scores, spark.createDataFrame(losses, "fold int, trees int, log_loss double, best boolean"), spark.createDataFrame(importances, "fold int, feature string, importance double"), models, left_out)


def train_oof(df: DataFrame, numeric: list[str], categorical: list[str], label: str, id_col: str, folds: int = 5, patience: int | None = None, **options) -> DataFrame:
    """Out-of-fold scores: ``id, fold, label, score``; the id is carried through, so nothing is matched by row order."""
    return cross_validate(df, numeric, categorical, label, id_col, folds, patience, losses_too=False, **options).scores


def train_final(df: DataFrame, numeric: list[str], categorical: list[str], label: str, path: str | None = None, id_col: str | None = None, **options) -> Trained:
    """Fits on all rows, and writes the model where a path is given. Without an ``id_col`` rows see whole statistics, their own label included."""
    trained = _fit(df, numeric, categorical, label, id_col, **options)
    if path:
        trained.save(path)
    return trained


def score_cohort(model: Trained, df: DataFrame, id_col: str, threshold: float = 0.5, strict: bool = False, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """escape_probability, predicted_class and label at a threshold (>=, or > with ``strict``), and the columns to ``keep``."""
    hit = F.col("score") > threshold if strict else F.col("score") >= threshold
    return model.scored(df).select(id_col, F.col("score").alias("escape_probability"), hit.cast("int").alias("predicted_class"), F.when(hit, "escape").otherwise("NMD").alias("predicted_label"), F.lit(threshold).alias("threshold_used"), *keep)


def check_scores(scored: DataFrame, id_col: str) -> DataFrame:
    """One row on a scored cohort: n, n_escape, n_nmd, repeated_ids (rows beyond an id's first), null_ids, missing (null or NaN scores), out_of_range, min, p25, median, p75, max and mean."""
    p = F.col("escape_probability")
    there = p.isNotNull() & ~F.isnan(p)
    valid = F.when(there, p)
    ids = scored.groupBy(id_col).agg(F.count("*").alias("rows")).agg(F.coalesce(F.sum(F.when(F.col(id_col).isNotNull(), F.col("rows") - 1)), F.lit(0)).cast("long").alias("repeated_ids"), F.coalesce(F.sum(F.when(F.col(id_col).isNull(), F.col("rows"))), F.lit(0)).cast("long").alias("null_ids"))
    whole = scored.agg(F.count("*").alias("n"), F.count_if(F.col("predicted_class") == 1).alias("n_escape"), F.count_if(F.col("predicted_class") == 0).alias("n_nmd"), F.count_if(~there | p.isNull()).alias("missing"), F.count_if(there & ~p.between(0, 1)).alias("out_of_range"), F.min(valid).alias("min"), F.max(valid).alias("max"), F.avg(valid).alias("mean"))
    q = quantiles(scored, "escape_probability", [0.25, 0.5, 0.75])
    # each side is one row
    out = whole.join(ids, F.lit(True)).join(q, F.lit(True), "left")
    return out.select("n", "n_escape", "n_nmd", "repeated_ids", "null_ids", "missing", "out_of_range", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "max", "mean")


def isotonic_recalibrate(oof: DataFrame, folds: int = 5, limit: float | None = None) -> DataFrame:
    """Fold-aware isotonic scores: each fold's from a fit on the others' distinct scores, weighed by their rows; adds ``calibrated``. ``oof`` should be a written table, since each fold reads it.

    With a ``limit`` (the source's is 0.03), scores stay as they are where the expected calibration error isn't above it.
    """
    if limit is not None:
        error = calibration_errors(calibration(oof)).first()["ece"]
        if error is None or error <= limit:
            return oof.withColumn("calibrated", F.col("score"))
    known = oof.filter(F.col("label").isNotNull()).groupBy("fold", "score").agg(F.avg(F.col("label").cast("double")).alias("label"), F.count("*").cast("double").alias("rows"))
    known, parts = written(known, "scores-by-fold"), []
    for k in range(folds):
        fit = IsotonicRegression(featuresCol="score", labelCol="label", weightCol="rows", predictionCol="calibrated").fit(known.filter(F.col("fold") != k))
        parts.append(fit.transform(oof.filter(F.col("fold") == k)))
    return reduce(DataFrame.unionByName, parts)


def attach_ids(predictions: DataFrame, ids: DataFrame, key: str, label: str) -> DataFrame:
    """Predictions with their ids' columns, one to one: raises where a key repeats on either side, where one has no partner (null keys have none), and where labels differ."""

    def once(df: DataFrame, side: str) -> DataFrame:
        g = df.withColumn("_n", F.count("*").over(Window.partitionBy(key)))  # on the join's own partitions and order
        return g.select(key, F.when(F.col("_n") == 1, F.struct(*[F.col(f"`{c}`") for c in df.columns if c != key])).otherwise(F.raise_error(F.concat(F.lit(f"repeated {key} of the {side}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).alias(f"_{side}"))

    j = once(predictions, "predictions").join(once(ids, "ids"), key, "full")
    lone = F.when(F.col("_predictions").isNull() | F.col("_ids").isNull(), F.raise_error(F.concat(F.lit(f"no partner for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    own = F.col("_predictions")[label]
    same = F.when(own.eqNullSafe(F.col("_ids")[label]), own).otherwise(F.raise_error(F.lit("labels differ")))
    checked = j.withColumn("_label", F.coalesce(lone, same))
    rest = [F.col("_predictions")[c].alias(c) for c in predictions.columns if c not in (key, label)]
    more = [F.col("_ids")[c].alias(c) for c in ids.columns if c not in (key, label) and c not in predictions.columns]
    return checked.select(key, F.col("_label").alias(label), *rest, *more)
