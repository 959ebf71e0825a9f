"""Categories of any number as target statistics: ordered ones for the rows that a model learns from, whole ones for others.

An ordered statistic is the share of positive labels among the rows of the same category that stand before the row in a permutation by
digest, so no row sees its own label. Rows are dealt by their category, one column after the other, and carry what they have: a shuffle for each
column, and none to put statistics back to their rows. A category with very many rows is dealt by parts of the permutation too, whose totals are
added up before, so a category, however common, is never one task. Statistics for models that leave a fold out each come from the same pass: sums
over all rows less those of the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ptclake.operators.ranks import dealt, keyed_join
from ptclake.sources.scratch import written

#: The share that a category without rows has, and how many rows it weighs.
PRIOR, WEIGHT = 0.5, 1.0
#: A category with more rows than this, and than a thousandth of all, is dealt by parts: at most a thousand of a column are.
MANY = 100_000
#: Categories are counted by this many hash buckets first, so that only those of full buckets are counted one by one.
BUCKETS = 16_384
#: Columns with at most as many categories are joined by a broadcast.
FEW = 65_536


def statistic_name(column: str) -> str:
    return f"{column}_statistic"


def _long(df: DataFrame, columns: list[str], *others) -> DataFrame:
    return df.select(*others, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("category")) for c in columns])).alias("c")).select("*", "c.*").drop("c")


def _statistic(positives, rows):
    return (positives + PRIOR * WEIGHT) / (rows + WEIGHT)


def _common(rows: DataFrame, columns: list[str]) -> tuple[int, dict[str, list[tuple[str | None, int]]]]:
    """The number of rows, and of each column the categories with so many rows that they go by parts, and their parts: a thousand at most."""
    bucket = F.pmod(F.xxhash64("category"), F.lit(BUCKETS))
    # a number for each column and bucket
    counts = [tuple(r) for r in _long(rows, columns).groupBy("column", bucket.alias("b")).agg(F.count("*").alias("n")).collect()]
    size = sum(n for c, _, n in counts if c == columns[0])
    many = max(MANY, size // 1000)
    full = {c: [b for d, b, n in counts if d == c and n > many] for c in columns}
    out: dict[str, list[tuple[str | None, int]]] = {c: [] for c in columns}
    for c in columns:
        if full[c]:
            g = _long(rows, [c]).filter(bucket.isin(full[c])).groupBy("category").agg(F.count("*").alias("n")).filter(F.col("n") > many)
            out[c] = [(r["category"], -(-r["n"] // many)) for r in g.collect()]
    return size, out


def ordered_statistics(df: DataFrame, columns: list[str], label: str, id_col: str, seed: int = 42, fold: str | None = None, folds: int = 0) -> DataFrame:
    """The rows, and for each column its ordered statistic (``<column>_statistic``), in the permutation by MD5 of seed and id.

    Null is a category like others; rows without a label get a statistic and count for none; rows of one id stand in any order among each other.
    With a ``fold`` (0 to ``folds`` - 1) a statistic is an array. Its element k is for the model that leaves fold k out and counts other folds'
    rows only: for their rows those before the row, for rows of fold k all.
    """
    rows = written(df, "category-rows")
    size, common = _common(rows, columns)
    y, n = F.coalesce(F.col(f"`{label}`").cast("double"), F.lit(0.0)), F.col(f"`{label}`").isNotNull().cast("long")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    own = F.col(f"`{fold}`") if fold else None
    # sums over all rows, and over those of each fold
    sums = {f"{name}{k}": x if k == "t" else F.when(own == k, x).otherwise(F.lit(0)) for k in ("t", *range(folds)) for name, x in (("_y", y), ("_n", n))}
    carried = [f"{s}{k}" for k in sums for s in ("_b", "_a")]
    zero = {k: F.lit(0.0 if k.startswith("_y") else 0).cast("double" if k.startswith("_y") else "long") for k in sums}

    def statistic(of, k: int) -> Column:
        return _statistic(of("_yt") - of(f"_y{k}"), of("_nt") - of(f"_n{k}"))

    out = rows
    for c in sorted(columns, key=lambda c: bool(common[c])):  # a common category's statistics are all different, so they travel least
        x = F.col(f"`{c}`").cast("string")
        if common[c]:
            hot = F.broadcast(out.sparkSession.createDataFrame(common[c], "_category string, _parts int"))
            place = F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * F.col("_parts") / F.lit(2**32)).cast("int")
            parted = lambda d: keyed_join(d.withColumn("_c", x), hot.withColumnRenamed("_category", "_c"), ["_c"], "left").withColumn("_part", F.coalesce(place, F.lit(-1))).drop("_parts")  # noqa: B023, E731
            t = parted(rows).filter("_part >= 0").groupBy("_c", "_part").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
            w = Window.partitionBy("_c")
            lower = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
            # a row for each part of a common category, so two thousand at most
            t = F.broadcast(t.select("_c", "_part", *[F.coalesce(F.sum(k).over(lower), zero[k]).alias(f"_b{k}") for k in sums], *[F.sum(k).over(w).alias(f"_a{k}") for k in sums]))
            out = keyed_join(dealt(parted(out), size, "_c", "_part"), t, ["_c", "_part"], "left")
        else:
            out = dealt(out.withColumn("_c", x), size, "_c")
        out = out.withColumn("_order", digest)
        w = Window.partitionBy("_c", *(["_part"] if common[c] else [])).orderBy("_order")
        upto, every = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        old = (lambda k: F.coalesce(F.col(f"_b{k}"), zero[k])) if common[c] else zero.get
        before = lambda k: F.coalesce(F.sum(sums[k]).over(upto), zero[k]) + old(k)  # noqa: B023, E731
        whole = lambda k: F.coalesce(F.col(f"_a{k}"), F.sum(sums[k]).over(every)) if common[c] else F.sum(sums[k]).over(every)  # noqa: B023, E731
        if fold:
            out = out.withColumns({f"_s{k}": before(k) for k in sums} | {f"_w{k}": whole(k) for k in sums})
            each = [F.when(own == k, statistic(lambda s: F.col(f"_w{s}"), k)).otherwise(statistic(lambda s: F.col(f"_s{s}"), k)) for k in range(folds)]
            out = out.withColumn(statistic_name(c), F.array(*each)).drop(*[f"{s}{k}" for k in sums for s in ("_s", "_w")])
        else:
            out = out.withColumn(statistic_name(c), _statistic(before("_yt"), before("_nt")))
        out = out.drop("_c", "_part", "_order", *carried)
    return out.select(*[f"`{c}`" for c in df.columns], *[f"`{statistic_name(c)}`" for c in columns])


def category_statistics(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """column, category and statistic over all labelled rows."""
    g = _long(df.filter(F.col(label).isNotNull()), columns, F.col(label).cast("double").alias("_y")).groupBy("column", "category")
    return g.agg(_statistic(F.sum("_y"), F.count("*")).alias("statistic"))


def apply_statistics(df: DataFrame, columns: list[str], statistics: DataFrame) -> DataFrame:
    """The rows with their categories' statistics; a category that isn't there has the prior's. ``statistics`` should be a written table, since each column reads it."""
    sizes = {r["column"]: r["count"] for r in statistics.groupBy("column").count().collect()}  # a number for each column
    out = df
    for c in columns:
        own = statistics.filter(F.col("column") == c).select(F.col("category").alias("_c"), F.col("statistic").alias("_statistic"))
        own = F.broadcast(own) if sizes.get(c, 0) <= FEW else own
        met = keyed_join(out.withColumn("_c", F.col(f"`{c}`").cast("string")), own, ["_c"], "left")
        out = met.withColumn(statistic_name(c), F.coalesce("_statistic", F.lit(PRIOR))).drop("_c", "_statistic")
    return out
