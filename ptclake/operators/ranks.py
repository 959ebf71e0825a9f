"""Ranks, numbers and exact quantiles without a task that holds a whole column, class or key.

Values are first counted. Their ranges (about ``PARTS``, cut at approximate quantiles of the distinct values) get running sums of their
own, and the ranges' totals, a few rows, are added up over the ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ptclake.sources.scratch import written

#: Ranges of values; each task sorts the values of one.
PARTS = 256
#: Rows that a shuffled part is to have at most, about.
PART_ROWS = 500_000
#: Up to so many parts a task writes each to a file; for more it sorts all its rows in memory, and spills those of a large piece of a file. So parts
#: have up to four times PART_ROWS before there are more of them.
UNSORTED = 200


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The frame (of so many rows) dealt by keys: into the session's number of parts, or more, so that a task's memory doesn't grow with the table."""
    n = -(-rows // PART_ROWS)
    n = n if n <= UNSORTED else max(UNSORTED, -(-rows // (4 * PART_ROWS)))
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def range_number(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are at most the value, by halving."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < cuts[mid], between(low, mid)).otherwise(between(mid + 1, high))

    return between(0, len(cuts))


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by keys of which null equals null; the keys are the left ones."""
    own = {k: f"_key{i}" for i, k in enumerate(keys)}
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in own.items()], F.lit(True))
    return left.join(right.withColumnsRenamed(own), same, how).drop(*own.values())


def value_cuts(values: DataFrame, column: str) -> list[float]:
    """At most PARTS - 1 cuts of a column with about as many rows between each."""
    return sorted(set(values.approxQuantile(column, [k / PARTS for k in range(1, PARTS)], 0.5 / PARTS)))


def _before(ranges: DataFrame, by: list[str]) -> DataFrame:
    """by, _r, _n, _before and _total from the rows of each range."""
    w = Window.partitionBy(*by)
    lower = w.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select(*by, "_r", "_n", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("_total"))


def value_ranks(df: DataFrame, value: str, by: list[str] | None = None, part: str | None = None) -> DataFrame:
    """Per ``by`` and numeric value: its rows (ties), the rows with lower values (lower) and all rows (total), and in ``part``, where named, the number of its range of values.

    Null and NaN values are left out; a null ``by`` is a key like others.
    """
    by = by or []
    x = F.col(value).cast("double")
    g = written(df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(*by, x.alias(value)).agg(F.count("*").alias("ties")), "value-counts")
    g = g.withColumn("_r", range_number(F.col(value), value_cuts(g, value)))
    ranges = _before(g.groupBy(*by, "_r").agg(F.sum("ties").alias("_n")), by)
    inner = Window.partitionBy(*by, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = keyed_join(g, ranges, [*by, "_r"])
    return joined.select(*by, value, "ties", (F.col("_before") + F.coalesce(F.sum("ties").over(inner), F.lit(0))).alias("lower"), F.col("_total").alias("total"), *([F.col("_r").alias(part)] if part else []))


def quantiles(df: DataFrame, value: str, points: list[float], by: list[str] | None = None) -> DataFrame:
    """Per ``by``: ``q``, the exact quantiles at the points, between neighbours in proportion; no row without values."""
    by = by or []
    ranks = value_ranks(df, value, by)
    wanted = []
    for p in points:
        h = (F.col("total") - 1) * F.lit(float(p))
        low = F.floor(h)
        at = lambda i: F.min(F.when((F.col("lower") <= i) & (i < F.col("lower") + F.col("ties")), F.col(value)))  # noqa: B023, E731
        wanted += [at(low), at(F.least(low + 1, F.col("total") - 1)), F.max(h - low)]
    out = ranks.groupBy(*by).agg(*[w.alias(f"_{k}") for k, w in enumerate(wanted)])
    each = [F.col(f"_{3 * k}") + (F.col(f"_{3 * k + 1}") - F.col(f"_{3 * k}")) * F.col(f"_{3 * k + 2}") for k in range(len(points))]
    return out.select(*by, F.array(*each).alias("q")).filter(F.col("q")[0].isNotNull())


def numbered(df: DataFrame, by: list[str], order: list[Column | str], part: Column, name: str, classes: bool = False) -> DataFrame:
    """``name``, a row's number from 0 within ``by`` in an order whose leading part is ``part``; rows are sorted per part.

    With ``classes``, ``by`` has few values, so the parts' totals are broadcast and rows are shuffled once.
    """
    x = df.withColumn("_r", part)
    ranges = _before(x.groupBy(*by, "_r").agg(F.count("*").alias("_n")), by)
    if classes:
        ranges = written(ranges, "range-totals")
        x, ranges = dealt(x, ranges.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0], *by, "_r"), F.broadcast(ranges.drop("_n"))
    inner = Window.partitionBy(*by, "_r").orderBy(*order)
    return keyed_join(x, ranges, [*by, "_r"]).withColumn(name, F.col("_before") + F.row_number().over(inner) - 1).select(*df.columns, name)
