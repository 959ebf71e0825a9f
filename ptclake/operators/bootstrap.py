"""Resampled intervals of the ROC-AUC, by vectors of prefix sums over the distinct scores.

The weights of n rows with one score and label add up to a Poisson number with mean n, so a number is drawn for each distinct score and
label and each replicate. Ranges of scores are tasks. Each adds up, for all replicates side by side, its positives, its negatives and the pairs
within it; a range's negatives meet the positives of the ranges above by one product of the two sums. So no draw becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ptclake.sources.scratch import written

#: Scores drawn for at once.
ROWS = 512


def draws(counts: list[int], seeds: list[int], replicates: int) -> np.ndarray:
    """[row, replicate]: Poisson numbers with a row's count as their mean, by a generator of the row's seed alone."""
    out = np.zeros((len(counts), replicates), np.int64)
    for k, (n, seed) in enumerate(zip(counts, seeds, strict=True)):
        if n:
            out[k] = np.random.Generator(np.random.PCG64(seed % 2**64)).poisson(n, replicates)
    return out


def auc_replicates(df: DataFrame, replicates: int = 1000, score: str = "score", label: str = "label") -> DataFrame:
    """replicate and roc_auc (ties count half; null where a replicate lacks a class). Rows without a score or a label, and NaN scores, are left out."""
    s = F.col(score).cast("double")
    x = df.filter(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull()).groupBy(s.alias("score")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    counts = written(x.select("score", "p", "n", *[F.xxhash64("score", F.lit(k)).alias(f"s{k}") for k in (1, 0)]), "bootstrap-counts")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg, pairs, seen = (*(np.zeros(replicates) for _ in range(3)), False)
        for batch in batches:
            for b in (batch.slice(k, ROWS) for k in range(0, len(batch), ROWS)):
                seen = True
                p, n, s1, s0 = (b.column(k).to_pylist() for k in range(1, 5))
                wp, wn = draws(p, s1, replicates), draws(n, s0, replicates)
                higher = np.cumsum(wp, axis=0) - wp + pos
                pairs += (wn * (higher + wp / 2)).sum(0)
                pos, neg = pos + wp.sum(0), neg + wn.sum(0)
        if seen:
            part = pa.array(np.full(replicates, TaskContext.get().partitionId(), np.int32))
            yield pa.RecordBatch.from_arrays([part, pa.array(np.arange(replicates, dtype=np.int32)), pa.array(pos), pa.array(neg), pa.array(pairs)], names=["part", "replicate", "pos", "neg", "pairs"])

    falling = F.col("score").desc()
    parts = counts.repartitionByRange(falling).sortWithinPartitions(falling).mapInArrow(add, "part int, replicate int, pos double, neg double, pairs double")
    above = F.coalesce(F.sum("pos").over(Window.partitionBy("replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    g = parts.withColumn("pairs", F.col("pairs") + F.col("neg") * above).groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "pairs")])
    return g.select("replicate", F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("pairs") / (F.col("pos") * F.col("neg"))).alias("roc_auc"))


def bootstrap_ci(df: DataFrame, replicates: int = 1000, score: str = "score", label: str = "label") -> DataFrame:
    """2.5, 50 and 97.5 percentiles of the ROC-AUC over Poisson-weighted replicates, and how many have one."""
    auc = auc_replicates(df, replicates, score, label)
    return auc.agg(F.expr("percentile(roc_auc, 0.025)").alias("low"), F.expr("percentile(roc_auc, 0.5)").alias("median"), F.expr("percentile(roc_auc, 0.975)").alias("high"), F.count("roc_auc").alias("replicates"))
