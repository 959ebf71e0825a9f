"""Feature tables: joins by id, profiles, pruning, imputation and audits. Column lists are schema-sized, so they live on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ptclake.functions.variants import strip_version
from ptclake.operators.ranks import quantiles, range_number, value_cuts
from ptclake.sources.scratch import written


def resolve_columns(df: DataFrame, candidates: dict[str, list[str]]) -> dict[str, str]:
    """The first present candidate of each name; an error where none is."""
    out = {}
    for name, options in candidates.items():
        found = [c for c in options if c in df.columns]
        if not found:
            raise ValueError(f"none of {options} for {name}; there are {df.columns}")
        out[name] = found[0]
    return out


def merge_annotations(base: DataFrame, tables: list[DataFrame], key: str) -> DataFrame:
    """Left joins by one key; of each table only columns that aren't there yet. The key is one shuffle for all tables."""
    out = base
    for t in tables:
        new = [c for c in t.columns if c not in out.columns]
        out = out.join(t.select(key, *new), key, "left")
    return out


def join_gene_features(variants: DataFrame, by_gene: list[DataFrame], by_key: list[DataFrame]) -> DataFrame:
    """Gene tables by version-stripped ``gene_id`` and variant tables by ``key``, all left."""
    out = variants.withColumn("_gene", strip_version(F.col("gene_id")))
    for t in by_gene:
        out = out.join(t.withColumn("_gene", strip_version(F.col("gene_id"))).drop("gene_id"), "_gene", "left")
    for t in by_key:
        out = out.join(t, "key", "left")
    return out.drop("_gene")


def halflife_with_fallback(variants: DataFrame, table: DataFrame) -> DataFrame:
    """Half-life by gene id, else by symbol (the first row per symbol, by gene id): adds half_life and half_life_from."""
    ids = table.groupBy(strip_version(F.col("gene_id")).alias("_id")).agg(F.first("half_life", ignorenulls=True).alias("_a"))
    names = table.groupBy(F.col("symbol").alias("_s")).agg(F.min_by("half_life", "gene_id").alias("_b"))
    j = variants.join(ids, strip_version(F.col("gene_id")) == F.col("_id"), "left").join(names, F.col("symbol") == F.col("_s"), "left")
    return j.withColumn("half_life", F.coalesce("_a", "_b")).withColumn("half_life_from", F.when(F.col("_a").isNotNull(), "gene_id").when(F.col("_b").isNotNull(), "symbol")).drop("_a", "_b", "_id", "_s")


def join_predictions(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that raises if a key repeats on either side, in the same pass as the join."""
    one = lambda d: d.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in d.columns if c != key])).alias("_r"))
    check = lambda d: one(d).select(key, F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string")))).alias("_r")).select(key, "_r.*")
    return check(left).join(check(right), key)


def compare_tables(a: DataFrame, b: DataFrame, key: str, tolerance: float = 1e-3, exact: list[str] | None = None) -> DataFrame:
    """Per shared column: rows compared, rows that agree, the largest difference. Null equals null; doubles within the tolerance."""
    cols = [c for c in a.columns if c in b.columns and c != key]
    kinds = dict(a.dtypes)
    j = a.select(key, *[F.col(c).alias(f"a_{c}") for c in cols]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in cols]), key)
    rows = []
    for c in cols:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        close = kinds[c] in ("double", "float") and c not in (exact or [])
        gap = F.abs(x - y) if close else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(c).alias("feature"), (x.eqNullSafe(y) | F.coalesce(gap <= tolerance, F.lit(False))).alias("same"), gap.cast("double").alias("gap")))
    long = j.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return long.groupBy("feature").agg(F.count("*").alias("n"), F.sum(F.col("same").cast("long")).alias("n_same"), F.max("gap").alias("max_gap"))


def tx_to_gene(features: DataFrame, variant_tx: DataFrame) -> DataFrame:
    """Distinct version-free (tx, gene) pairs of the transcripts that variants name."""
    pairs = features.select(strip_version(F.col("tx")).alias("tx"), strip_version(F.col("gene")).alias("gene")).distinct()
    return pairs.join(variant_tx.select(strip_version(F.col("tx")).alias("tx")), "tx", "left_semi")


def row_median(columns: list[str], log2: bool = False) -> Column:
    """The median across columns of a row, nulls left out; log2(x + 1) on request."""
    a = F.array_sort(F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull()))
    n = F.size(a)
    mid = F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)
    return F.log2(mid + 1) if log2 else mid


def zscore_tertiles(df: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    """z by the reference's mean and sample deviation, and the third of the reference's quantiles (closed above, lowest included)."""
    r = reference.agg(F.mean(column).alias("_m"), F.stddev_samp(column).alias("_s")).join(F.broadcast(quantiles(reference, column, [1 / 3, 2 / 3]).withColumnRenamed("q", "_q")), F.lit(True), "left")
    x = F.col(column)
    return df.crossJoin(F.broadcast(r)).withColumn("z", F.when(F.col("_s") > 0, (x - F.col("_m")) / F.col("_s"))).withColumn("tertile", F.when(x <= F.col("_q")[0], "low").when(x <= F.col("_q")[1], "medium").when(x.isNotNull(), "high")).drop("_m", "_s", "_q")


def _unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])).alias("r")).select("r.*")


def feature_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column: non-null rows and percent, mean, deviation, least, most; zero_variance below 1e-10. One pass."""
    g = _unpivot(df, columns).groupBy("feature").agg(F.count("*").alias("n_rows"), F.count("value").alias("n"), F.mean("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    return g.withColumn("pct", F.round(100 * F.col("n") / F.col("n_rows"), 2)).withColumn("zero_variance", F.coalesce(F.col("sd") < 1e-10, F.lit(True)))


def match_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null rows and percent of each column, any type, in one pass."""
    n = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n"), F.round(100 * F.col(c) / F.col("_n"), 2).alias("pct")) for c in columns])).alias("r")).select("r.*")


def duplicate_columns(names: list[str]) -> list[str]:
    return sorted({c for c in names if names.count(c) > 1})


def categorical_columns(df: DataFrame, declared: list[str]) -> list[str]:
    """Declared columns, numeric ones that hold only 0 and 1, and the remaining strings and booleans."""
    numeric = [c for c, k in df.dtypes if c not in declared and k in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    row = df.agg(*[F.coalesce(F.min(F.col(c).isin(0, 1)), F.lit(False)).alias(c) for c in numeric]).first() if numeric else {}
    return [c for c, k in df.dtypes if c in declared or k in ("string", "boolean") or c in numeric and row[c]]


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """The exact median of each column; null where it has no value. A row per column goes to the driver."""
    found = {r["feature"]: r["q"][0] for r in quantiles(_unpivot(df, columns), "value", [0.5], ["feature"]).collect()}
    return {c: found.get(c) for c in columns}


def fold_medians(df: DataFrame, columns: list[str], fold: str, folds: int) -> DataFrame:
    """feature, fold and median: of each column over all folds but the one, for a model that leaves it out; null where those have no value.

    Values are counted once, with a count for each fold. A fold's counts are the totals less its own, so no fold needs a scan of its own. Null and
    NaN values, and rows without a fold or with one beyond ``folds``, count for nothing.
    """
    own = [F.count_if(F.col("_f") == k) for k in range(folds)]
    rows = df.select(F.col(fold).alias("_f"), *[F.col(f"`{c}`") for c in columns if c != fold]).filter(F.col("_f").between(0, folds - 1))
    long = rows.select("_f", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])).alias("r")).select("_f", "r.*").filter("value IS NOT NULL AND NOT isnan(value)")
    g = written(long.groupBy("feature", "value").agg(F.count("*").alias("n"), *[c.alias(f"n{k}") for k, c in enumerate(own)]), "fold-counts")
    rest = [f"t{k}" for k in range(folds)]
    g = g.select("feature", "value", *[(F.col("n") - F.col(f"n{k}")).alias(f"t{k}") for k in range(folds)]).withColumn("_r", range_number(F.col("value"), value_cuts(g, "value")))
    lower = Window.partitionBy("feature").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = g.groupBy("feature", "_r").agg(*[F.sum(t).alias(t) for t in rest])
    ranges = ranges.select("feature", "_r", *[F.coalesce(F.sum(t).over(lower), F.lit(0)).alias(f"b_{t}") for t in rest], *[F.sum(t).over(Window.partitionBy("feature")).alias(f"a_{t}") for t in rest])
    inner = Window.partitionBy("feature", "_r").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = g.join(ranges, ["feature", "_r"]).select("feature", "value", *rest, *[F.col(f"a_{t}") for t in rest], *[(F.col(f"b_{t}") + F.coalesce(F.sum(t).over(inner), F.lit(0))).alias(f"l_{t}") for t in rest])
    at = lambda t, i: F.min(F.when((F.col(f"l_{t}") <= i) & (i < F.col(f"l_{t}") + F.col(t)), F.col("value")))
    mid = lambda t: (at(t, F.floor((F.col(f"a_{t}") - 1) / 2)) + at(t, F.floor(F.col(f"a_{t}") / 2))) / 2
    out = placed.groupBy("feature").agg(F.array(*[mid(t) for t in rest]).alias("m"))
    return out.select("feature", F.posexplode("m").alias("fold", "median"))


def impute(df: DataFrame, categorical: list[str], zero: list[str], numeric: list[str], training: dict[str, float] | None = None) -> DataFrame:
    """Categoricals to strings with MISSING, structural zeros, then medians of the remaining numeric columns (or those of training)."""
    rest = [c for c in numeric if c not in zero and c not in categorical]
    values = training if training is not None else medians(df, rest) if rest else {}
    new = {c: F.coalesce(F.col(c).cast("string"), F.lit("MISSING")) for c in categorical}
    new |= {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in zero}
    new |= {c: F.coalesce(F.col(c).cast("double"), F.lit(values.get(c)).cast("double")) for c in rest}
    return df.withColumns(new)


def audit_columns(df: DataFrame, model: list[str]) -> DataFrame:
    """Per column of the table or of the model's list: status present, missing or extra, and its nulls."""
    present = [c for c in model if c in df.columns]
    extra = [c for c in df.columns if c not in model]
    nulls = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in [*present, *extra]])
    rows = [F.struct(F.lit(c).alias("feature"), F.lit(s).alias("status"), (F.col("_n") - (F.col(c) if s != "missing" else F.lit(0))).alias("n_null")) for s, cs in (("present", present), ("missing", [c for c in model if c not in df.columns]), ("extra", extra)) for c in cs]
    return nulls.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def write_aligned(df: DataFrame, model: dict[str, str], path: str, fills: dict[str, object], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Writes ``keep`` and the model's columns as Parquet, filled by ``fills`` (column to value), and returns the audit that is counted while they are written.

    The audit has a row for each column of the model or the table: feature, status (present, missing, extra), n_null (before), n_lost (values that
    don't fit the model's type), n_filled and n_residual (nulls as written). No second scan is made for it; an extra column's
    nulls aren't counted, since it isn't read.
    """
    before, after = Observation(), Observation()
    has = [c for c in model if c in df.columns]
    null = lambda c: F.count_if(F.col(f"`{c}`").isNull())
    lost = lambda c: F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(model[c]).isNull())
    seen = df.observe(before, F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{i}") for i, c in enumerate(has) for k, f in (("null", null), ("lost", lost))])
    filled = align_columns(seen, model, keep).withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v).cast(model[c])) for c, v in fills.items() if c in model})
    filled.observe(after, F.count(F.lit(1)).alias("n"), *[null(c).alias(f"null_{i}") for i, c in enumerate(model)]).write.mode("overwrite").parquet(path)
    x, y = before.get, after.get
    rows = []
    for i, c in enumerate(model):
        k = has.index(c) if c in has else None
        nulls, gone = (x[f"null_{k}"], x[f"lost_{k}"]) if k is not None else (x["n"], 0)
        rows.append((c, "missing" if k is None else "present", nulls, gone, nulls + gone - y[f"null_{i}"], y[f"null_{i}"]))
    rows += [(c, "extra", None, None, None, None) for c in df.columns if c not in model and c not in keep]
    return df.sparkSession.createDataFrame(rows, "feature string, status string, n_null long, n_lost long, n_filled long, n_residual long")


def align_columns(df: DataFrame, model: dict[str, str], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """``keep`` and the model's columns (name to type), in its order: missing ones are null, types that don't fit are null too, others are left out."""
    return df.select(*keep, *[(F.col(f"`{c}`").try_cast(k) if c in df.columns else F.lit(None).cast(k)).alias(c) for c, k in model.items()])


def drop_columns(df: DataFrame, rules: dict[str, str], patterns: tuple[str, ...] = (), rename: dict[str, list[str]] | None = None) -> DataFrame:
    """Drops columns by name (with a reason) and by pattern, and renames the first present candidate of each new name."""
    gone = [c for c in df.columns if c in rules or any(p in c for p in patterns)]
    out = df.drop(*gone)
    for new, old in (rename or {}).items():
        found = next((c for c in old if c in out.columns), None)
        out = out.withColumnRenamed(found, new) if found and new not in out.columns else out
    return out


def select_top_features(df: DataFrame, ranking: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """The n best columns by ``ranking(feature, importance)`` beside ``keep``; an error if one is missing."""
    best = [r[0] for r in ranking.orderBy(F.desc("importance"), "feature").limit(n).collect()]
    if gone := [c for c in best if c not in df.columns]:
        raise ValueError(f"missing features {gone}")
    return df.select(*keep, *best)


def aggregate_tx(df: DataFrame, key: str, columns: list[str], how: str = "max") -> DataFrame:
    """Per variant the max, sum, mean or min over its transcripts."""
    return df.groupBy(key).agg(*[getattr(F, how)(c).alias(c) for c in columns])


def attach_transcript_features(variants: DataFrame, cds: DataFrame, utr3: DataFrame, utr5: DataFrame, flags: dict[str, DataFrame]) -> DataFrame:
    """Transcript tables on ``tx`` (UTRs left to the CDS table), then the variants; each flag is yes where its table has the transcript."""
    t = reduce(lambda x, y: x.join(y, "tx", "left"), (cds, utr3, utr5))
    for name, has in flags.items():
        t = t.join(has.select("tx").distinct().withColumn(name, F.lit("yes")), "tx", "left").withColumn(name, F.coalesce(name, F.lit("no")))
    return variants.join(t, "tx", "left")
