"""Evaluation of scores: exact metrics with ties, thresholds, resampling, calibration, tiers and per-feature tests.

Scores are first grouped by value, and running sums over the distinct scores come in two steps (within ranges of scores, then
over the ranges' totals), so no step puts all rows in one task.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ptclake.functions.variants import assign_tier
from ptclake.operators.ranks import keyed_join, quantiles, range_number, value_cuts, value_ranks
from ptclake.sources.scratch import written


def score_table(df: DataFrame, score: str = "score", label: str = "label", weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Per ``by`` and score: positives p and negatives n, with those of higher scores (tp0, fp0) and the totals pos and neg.

    Rows without a score or a label, and NaN scores, are left out; a null ``by`` is a key like others. Ranges of scores are cut at approximate
    quantiles of the distinct ones; running sums within a range go by (by, range).
    """
    by = by or []
    w = weight if weight is not None else F.lit(1)
    s = F.col(score).cast("double")
    g = df.filter(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull()).groupBy(*by, s.alias("score")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("n"))
    g = written(g, "score-counts")
    g = g.withColumn("_r", range_number(F.col("score"), value_cuts(g, "score")))
    ranges = g.groupBy(*by, "_r").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    higher = Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    ranges = ranges.select(*by, "_r", F.coalesce(F.sum("rp").over(higher), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(higher), F.lit(0)).alias("bn"), F.sum("rp").over(whole).alias("pos"), F.sum("rn").over(whole).alias("neg"))
    inner = Window.partitionBy(*by, "_r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return keyed_join(g, ranges, [*by, "_r"]).select(*by, "score", "p", "n", (F.col("bp") + F.coalesce(F.sum("p").over(inner), F.lit(0))).alias("tp0"), (F.col("bn") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("fp0"), "pos", "neg")


def roc_pr(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ROC-AUC (ties count half) and PR-AUC (average precision) from a score table; null without both classes."""
    tp, fp = F.col("tp0") + F.col("p"), F.col("fp0") + F.col("n")
    roc = F.sum(F.col("n") * (F.col("tp0") + F.col("p") / 2)) / F.max(F.col("pos").cast("double") * F.col("neg"))
    pr = F.sum(F.when(F.col("p") > 0, F.col("p") * (tp / (tp + fp))).otherwise(0.0)) / F.max("pos")
    both = (F.max("pos") > 0) & (F.max("neg") > 0)
    return table.groupBy(*(by or [])).agg(F.when(both, roc).alias("roc_auc"), F.when(both, pr).alias("pr_auc"), F.max("pos").cast("long").alias("n_pos"), F.max("neg").cast("long").alias("n_neg"))


def brier_log_loss(df: DataFrame, score: str = "score", label: str = "label", eps: float = 1e-15) -> DataFrame:
    p, y = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(score))), F.col(label)
    return df.agg(F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def within_bin_auc(df: DataFrame, by: str, least: int = 10) -> DataFrame:
    """ROC-AUC per bin, null with fewer than ``least`` rows of a class."""
    out = roc_pr(score_table(df, by=[by]), [by])
    return out.select(by, "n_pos", "n_neg", F.when((F.col("n_pos") >= least) & (F.col("n_neg") >= least), F.col("roc_auc")).alias("roc_auc"))


def fold_summary(df: DataFrame, fold: str) -> DataFrame:
    """Out-of-fold AUC, mean and population deviation of the folds' AUCs, and the best fold."""
    each = roc_pr(score_table(df, by=[fold]), [fold])
    s = each.agg(F.avg("roc_auc").alias("mean_auc"), F.stddev_pop("roc_auc").alias("sd_auc"), F.max_by(fold, F.struct("roc_auc", -F.col(fold))).alias("best_fold"))
    return roc_pr(score_table(df)).select(F.col("roc_auc").alias("oof_auc")).crossJoin(s)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> list[Column]:
    sens, spec, ppv = _ratio(tp, tp + fn), _ratio(tn, tn + fp), _ratio(tp, tp + fp)
    return [sens.alias("sensitivity"), spec.alias("specificity"), ppv.alias("ppv"), _ratio(tn, tn + fn).alias("npv"), _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ((sens + spec) / 2).alias("balanced_accuracy")]


def binary_metrics(df: DataFrame, threshold: float, score: str = "score", label: str = "label", strict: bool = False) -> DataFrame:
    """Confusion counts and rates of score >= threshold (> with ``strict``)."""
    hit = F.col(score) > threshold if strict else F.col(score) >= threshold
    count = lambda p, y: F.count(F.when((hit == p) & (F.col(label) == y), 1))
    c = df.agg(count(True, 1).alias("tp"), count(True, 0).alias("fp"), count(False, 0).alias("tn"), count(False, 1).alias("fn"))
    return c.select("*", *rates(*[F.col(x) for x in ("tp", "fp", "tn", "fn")]))


def threshold_at(table: DataFrame, specificity: float = 0.9, sensitivity: float = 0.9) -> DataFrame:
    """Thresholds by Youden's index (the highest of equal ones), by target specificity (highest sensitivity there) and by target sensitivity (highest specificity)."""
    t = table.select("score", ((F.col("tp0") + F.col("p")) / F.col("pos")).alias("sens"), (1 - (F.col("fp0") + F.col("n")) / F.col("neg")).alias("spec"))
    best = lambda when, *keys: F.max_by(F.struct("score", "sens", "spec"), F.when(when, F.struct(*keys)))
    r = t.agg(best(F.lit(True), F.round(F.col("sens") + F.col("spec") - 1, 12).alias("j"), F.col("score")).alias("youden"), best(F.col("spec") >= specificity, F.col("sens"), F.col("spec"), F.col("score")).alias("at_specificity"), best(F.col("sens") >= sensitivity, F.col("spec"), F.col("sens"), F.col("score")).alias("at_sensitivity"))
    names = ("youden", "at_specificity", "at_sensitivity")
    return r.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"{k}.score").alias("threshold"), F.col(f"{k}.sens").alias("sensitivity"), F.col(f"{k}.spec").alias("specificity")) for k in names])).alias("x")).select("x.*")


def calibration(df: DataFrame, bins: int = 10, quantile: bool = True, score: str = "score", label: str = "label") -> DataFrame:
    """Per bin (left-closed by the inner edges, equal edges merged): n, mean score, observed rate and gap."""
    inner = [k / bins for k in range(1, bins)]
    edges = quantiles(df, score, inner).select(F.array_distinct("q").alias("edges")) if quantile else df.sparkSession.createDataFrame([(inner,)], "edges array<double>")
    x = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: F.col(score) >= e)))
    return x.groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate")).withColumn("gap", F.abs(F.col("mean_score") - F.col("rate")))


def calibration_errors(bins: DataFrame) -> DataFrame:
    """Expected and maximal calibration error of a calibration table."""
    return bins.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def tier_breakdown(df: DataFrame, cohort: str = "cohort", score: str = "score", label: str = "label") -> DataFrame:
    """Per cohort and tier, with a TOTAL row: n, percent, mean score, observed rate and their difference."""
    g = df.withColumn("tier", assign_tier(F.col(score))).rollup(cohort, "tier").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"), F.grouping_id().alias("_g")).filter("_g < 3")
    g = g.withColumn("tier", F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("tier")))
    total = Window.partitionBy(cohort)
    return g.select(cohort, "tier", "n", F.round(100 * F.col("n") / F.max("n").over(total), 1).alias("pct"), "mean_score", "rate", (F.col("mean_score") - F.col("rate")).alias("calibration_gap"))


def tier_pivot(breakdown: DataFrame, tiers: list[str], cohort: str = "cohort") -> DataFrame:
    """Percent by cohort (rows) and tier (columns), zero where a cohort has none."""
    return breakdown.groupBy(cohort).pivot("tier", tiers).agg(F.first("pct")).fillna(0.0, tiers)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2x2 table, as the sum of probabilities no larger than the observed one.

    Both tails are summed outwards until their terms no longer count, so the steps follow the spread of the table, not its size.
    """
    lg = math.lgamma
    row, col, n = a + b, a + c, a + b + c + d
    base = lg(row + 1) + lg(n - row + 1) + lg(col + 1) + lg(n - col + 1) - lg(n + 1)
    logp = lambda x: base - lg(x + 1) - lg(row - x + 1) - lg(col - x + 1) - lg(n - row - col + x + 1)
    least, most = max(0, row + col - n), min(row, col)
    mode = min(most, max(least, (row + 1) * (col + 1) // (n + 2)))
    seen = logp(a) + 1e-7
    if logp(mode) <= seen:
        return 1.0

    def tail(end: int, step: int) -> float:
        """The terms from the first one beyond the mode that is small enough to ``end``."""
        near, far = mode, end  # terms fall from the mode on
        if logp(far) > seen:
            return 0.0
        while abs(far - near) > 1:
            mid = (near + far) // 2
            near, far = (near, mid) if logp(mid) <= seen else (mid, far)
        total, x = 0.0, far
        while least <= x <= most:
            term = math.exp(logp(x))
            total += term
            if term <= total * 1e-17:
                break
            x += step
        return total

    return min(1.0, tail(least, -1) + tail(most, 1))


def tier_enrichment(df: DataFrame, tier: str, one: str, other: str, cohort: str = "cohort", score: str = "score") -> DataFrame:
    """Share of a tier in two cohorts: counts, fold change of percents rounded to 0.1, odds ratio and Fisher's exact p (of four numbers)."""
    hit = assign_tier(F.col(score)) == tier
    count = lambda k, h: F.count(F.when((F.col(cohort) == k) & (hit == h), 1))
    a, b, c, d = df.agg(count(one, True), count(one, False), count(other, True), count(other, False)).first()
    pct = lambda x, y: round(100 * x / (x + y), 1) if x + y else None
    p, q = pct(a, b), pct(c, d)
    row = (tier, one, other, a, b, c, d, p / q if q and p is not None else None, a * d / (b * c) if b * c else None, fisher_exact(a, b, c, d))
    return df.sparkSession.createDataFrame([row], "tier string, cohort string, other string, a long, b long, c long, d long, fold_change double, odds_ratio double, p_value double")


def normal_p(z: Column) -> Column:
    """Two-sided p of a normal deviate by a rational approximation of the error function (absolute error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def rank_with_ties(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Per ``by`` and value: its count and average rank, from counts by value."""
    return value_ranks(df, value, by).select(*by, value, "ties", (F.col("lower") + (F.col("ties") + 1) / 2).alias("rank"))


def bh_adjust(df: DataFrame, p: str = "p_value", name: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q of a table of tests (a row per test); tests without a p (null or NaN) have none and count for none.

    The least p * tests / rank from a p on runs within ranges of p, and then over the ranges, so no task holds all tests. Equal p's have the last one's rank.
    """
    tests = written(df, "tests")
    ranks = value_ranks(tests.select(F.col(p).alias("_p")), "_p", part="_part").select("_p", "_part", (F.col("_p") * F.col("total") / (F.col("lower") + F.col("ties"))).alias("_q"))
    above = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    later = ranks.groupBy("_part").agg(F.min("_q").alias("_least")).select(F.col("_part"), F.min("_least").over(above).alias("_later"))
    onward = Window.partitionBy("_part").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    q = ranks.join(later, "_part").select("_p", F.least(F.lit(1.0), F.min("_q").over(onward), F.col("_later")).alias(name))
    return tests.join(q, F.col(p).cast("double") == F.col("_p"), "left").drop("_p")


@lru_cache(maxsize=256)
def rank_sum_counts(m: int, n: int) -> tuple[float, ...]:
    """How many choices of m ranks out of 1 to m + n have each U from 0 to m n, by taking the ranks up one after the other."""
    import numpy as np

    ways = np.zeros((m + 1, m * n + 1))  # [ranks chosen, U so far]: the j-th chosen rank r adds r - j
    ways[0, 0] = 1
    for r in range(1, m + n + 1):
        for j in range(min(m, r), 0, -1):
            up = r - j
            if up <= m * n:
                ways[j, up:] += ways[j - 1, : m * n + 1 - up]
    return tuple(ways[m].tolist())


def exact_rank_sum_p(u: float, m: int, n: int) -> float:
    """Two-sided p of U without ties: twice the smaller tail, at most 1."""
    ways, k = rank_sum_counts(m, n), round(u)
    low, high, total = math.fsum(ways[: k + 1]), math.fsum(ways[k:]), math.fsum(ways)
    return min(1.0, 2 * min(low, high) / total)


def motif_effect(long: DataFrame, least: int = 2, exact: int = 50) -> DataFrame:
    """Per motif of ``long(motif, present, value)``: means, difference, standard error, 95% interval, rank-sum p, whether it is exact, and BH q.

    Motifs with fewer than ``least`` rows in a group are left out, a null motif is one like others. The p is exact where both groups are below ``exact``
    and no value repeats, else the normal approximation with corrections for ties and continuity.
    """
    import pandas as pd

    v = long.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")) & F.col("present").isNotNull())
    m = v.groupBy("motif").agg(*[f(F.when(F.col("present") == k, F.col("value"))).alias(f"{n}{k}") for k in (0, 1) for f, n in ((F.count, "n"), (F.avg, "mean"), (F.var_samp, "var"))])
    m = m.filter((F.col("n0") >= least) & (F.col("n1") >= least))
    ones = v.filter("present = 1").groupBy("motif", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("ones"))
    r = keyed_join(rank_with_ties(v, "value", ["motif"]), ones, ["motif", "value"], "left")
    w = r.groupBy("motif").agg(F.sum(F.col("ones") * F.col("rank")).alias("w1"), F.sum(F.col("ties").cast("double") * (F.col("ties") * F.col("ties") - 1)).alias("tie"))
    j = keyed_join(m, w, ["motif"])
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    u = F.col("w1") - n1 * (n1 + 1) / 2 - n0 * n1 / 2
    sigma = F.sqrt(n0 * n1 / 12 * ((n0 + n1 + 1) - F.col("tie") / ((n0 + n1) * (n0 + n1 - 1))))
    z = F.when(sigma > 0, (u - F.signum(u) * 0.5) / sigma)
    few = (F.col("n0") < exact) & (F.col("n1") < exact) & (F.col("tie") == 0)

    @F.pandas_udf("double")  # a row per motif
    def p_of(u, m, n, few):
        return pd.Series([exact_rank_sum_p(a, int(b), int(c)) if ok else None for a, b, c, ok in zip(u, m, n, few, strict=True)], dtype="float64")

    diff, se = F.col("mean1") - F.col("mean0"), F.sqrt(F.col("var1") / n1 + F.col("var0") / n0)
    p = F.when(few, p_of(u + n0 * n1 / 2, "n1", "n0", few)).otherwise(normal_p(z))
    out = j.select("motif", "n1", "n0", "mean1", "mean0", diff.alias("diff"), se.alias("se"), (diff - 1.96 * se).alias("low"), (diff + 1.96 * se).alias("high"), p.alias("p_value"), few.alias("exact"))
    return bh_adjust(out)


def importance_rank(folds: DataFrame, contributions: DataFrame) -> DataFrame:
    """Mean and deviation of importances over folds, mean absolute contributions, full outer join and ranks (1 is best).

    Contributions are rows (feature, contribution), or sums of their absolute values (feature, total, n).
    """
    a = folds.groupBy("feature").agg(F.avg("importance").alias("mean_importance"), F.stddev_samp("importance").alias("sd_importance"))
    mean = F.sum("total") / F.sum("n") if "total" in contributions.columns else F.avg(F.abs("contribution"))
    b = contributions.groupBy("feature").agg(mean.alias("mean_abs_contribution"))
    j = a.join(b, "feature", "full")
    rank = lambda c: F.rank().over(Window.orderBy(F.col(c).desc_nulls_last()))  # noqa: E731  a row per feature
    return j.withColumn("importance_rank", rank("mean_importance")).withColumn("contribution_rank", rank("mean_abs_contribution"))


def top_k(df: DataFrame, column: str, k: int, ties: list[str]) -> DataFrame:
    """The k rows with the largest values (nulls last), ties by further columns."""
    return df.orderBy(F.col(column).desc_nulls_last(), *ties).limit(k)


def sort_results(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in the order of ``keys``, by range partitions."""
    return df.orderBy(*keys)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn("counter", F.lit(column)).select("counter", "value", "n")
