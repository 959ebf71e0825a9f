"""Interval operators on equi-joins over nested grids of bins. Intervals are 1-based and inclusive unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 16_384
#: Each grid's bins are so many times as wide as those of the one before.
FACTOR = 8
#: Grids: the widest bins are longer than any sequence (BIN * FACTOR ** 6 is above 4 * 10**9).
GRIDS = 7


def _bins(start: Column, end: Column, grid: Column, width: int) -> Column:
    """The bins of a grid that an interval touches, at most two where it isn't longer than a bin."""
    size = F.element_at(F.array(*[F.lit(width * FACTOR**g) for g in range(GRIDS)]), grid + 1)
    return F.sequence(F.floor(start / size).cast("long"), F.floor(end / size).cast("long"))


def _grid(width: int) -> Column:
    """The finest grid whose bins are at least as long as the interval."""
    length = F.col("end") - F.col("start") + 1
    out = F.lit(GRIDS - 1)
    for g in range(GRIDS - 2, -1, -1):
        out = F.when(length <= width * FACTOR**g, g).otherwise(out)
    return out.cast("int")


def with_bins(df: DataFrame, width: int = BIN) -> DataFrame:
    """A row for each bin of its own grid (``_grid``) that an interval touches, in ``_bin``: at most two, however long it is. Intervals that end before they start touch none."""
    own = df.filter(F.col("end") >= F.col("start")).withColumn("_grid", _grid(width))
    return own.withColumn("_bin", F.explode(_bins(F.col("start"), F.col("end"), F.col("_grid"), width)))


def with_partner_bins(df: DataFrame, other: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """A row for each bin that an interval touches in the coarser grids that ``other`` has intervals in, on the same keys.

    Such grids are found first (a row per key), so where all intervals are short, no row is made here.
    """
    grids = other.filter(F.col("end") >= F.col("start")).select(*keys, _grid(width).alias("_g")).groupBy(*keys).agg(F.collect_set("_g").alias("_grids"))
    own = df.filter(F.col("end") >= F.col("start")).withColumn("_own", _grid(width)).join(grids, keys)
    coarse = own.withColumn("_grid", F.explode(F.filter("_grids", lambda g: g > F.col("_own")))).drop("_own", "_grids")
    return coarse.withColumn("_bin", F.explode(_bins(F.col("start"), F.col("end"), F.col("_grid"), width)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """Pairs of ``left`` and ``right`` rows (both with ``start``, ``end``) that overlap on equal ``keys``, each once; right columns get the prefix ``r_``.

    Grids nest, and an interval lies in the finest one whose bins are as long as it is. A pair meets in the coarser of its two grids:
    there one side looks up the other's bins. It is kept in the first bin that both touch, so no distinct is needed. So an interval is at most
    two rows in its own grid and two for each coarser grid that the other side uses, whatever its length. Null keys match nothing.
    """
    size = F.element_at(F.array(*[F.lit(width * FACTOR**g) for g in range(GRIDS)]), F.col("_grid") + 1)
    named = lambda d: d.select(*[F.col(k) for k in keys], "_grid", "_bin", *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        both = x.join(named(y), [*keys, "_grid", "_bin"])
        first = F.floor(F.greatest("start", "r_start") / size)
        return both.filter((F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end")) & (F.col("_bin") == first)).drop("_bin", "_grid")

    own = with_bins(left, width)
    wide = own.unionByName(with_partner_bins(left, right, keys, width))
    return met(wide, with_bins(right, width)).unionByName(met(own, with_partner_bins(right, left, keys, width)))


def overlap_semi(features: DataFrame, intervals: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """Features that touch any interval, as a left-semi join: repeated rows stay repeated. The places that are touched are found first, so whole rows are shuffled once."""
    place = [*keys, "start", "end"]
    touched = overlap_join(features.select(*place).distinct(), intervals.select(*place), keys, width).select(*place).distinct()
    return features.join(touched, place, "left_semi").select(*features.columns)


def count_overlaps(windows: DataFrame, intervals: DataFrame, id_col: str, keys: list[str], ids: DataFrame, width: int = BIN) -> DataFrame:
    """Per id the number of intervals that its windows touch, with zero for ids without a window or a touch: ``id, n, any``.

    No pair is made: a window touches the intervals that start up to its end, less those that end before its start. Starts and ends are counted by
    place, summed up within bins of ``width`` and over the bins' totals, so the work grows with the rows and not with the touches. Null keys match nothing.
    """
    place = lambda at, starts, ends: F.struct(F.col(at).cast("long").alias("_at"), F.lit(starts).cast("long").alias("_s"), F.lit(ends).cast("long").alias("_e"))
    valid = lambda d: d.filter(F.col("end") >= F.col("start")).dropna(subset=keys)
    marks = lambda d, k: valid(d).select(*keys, F.explode(F.array(place("start", k, 0), place("end", 0, k))).alias("_m")).select(*keys, "_m.*")
    by = [*keys, "_bin"]
    every = marks(intervals, 1).unionByName(marks(windows, 0)).withColumn("_bin", F.floor(F.col("_at") / width))
    g = every.groupBy(*by, "_at").agg(F.sum("_s").alias("_s"), F.sum("_e").alias("_e"))
    lower = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = every.groupBy(*by).agg(F.sum("_s").alias("_s"), F.sum("_e").alias("_e"))
    bins = bins.select(*by, *[F.coalesce(F.sum(c).over(lower), F.lit(0)).alias(f"{c}0") for c in ("_s", "_e")])
    inner = Window.partitionBy(*by).orderBy("_at")
    upto, before = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(Window.unboundedPreceding, -1)
    started, ended = F.col("_s0") + F.sum("_s").over(upto), F.col("_e0") + F.coalesce(F.sum("_e").over(before), F.lit(0))
    sums = g.join(bins, by).select(*keys, "_at", started.alias("_started"), ended.alias("_ended"))
    asked = valid(windows).select(*keys, F.col(id_col).alias("_id"), F.explode(F.array(place("start", 0, -1), place("end", 1, 0))).alias("_m")).select(*keys, "_id", "_m.*")
    n = asked.join(sums, [*keys, "_at"]).groupBy("_id").agg(F.sum(F.col("_s") * F.col("_started") + F.col("_e") * F.col("_ended")).alias("n"))
    out = ids.select(id_col).distinct().join(n, F.col(id_col) == F.col("_id"), "left")
    return out.select(id_col, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n") > 0, "yes").otherwise("no").alias("any"))


def region_median(regions: DataFrame, track: DataFrame, keys: list[str], by: list[str], width: int = BIN) -> DataFrame:
    """Per ``by`` (say variant and region): total_bp of its blocks, valid_bp with a value, and the exact median of the values per base.

    ``track`` has a value per run of bases; runs are clipped to the blocks and weigh by their length, so no base is exploded. An even count
    of bases averages the two middle ones. Regions without a value have a null median.
    """
    size = regions.groupBy(*by).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("start") + 1)).cast("long").alias("total_bp"))
    hit = overlap_join(regions.select(*keys, *by, "start", "end"), track.filter("value IS NOT NULL").select(*keys, "start", "end", "value"), keys, width)
    runs = hit.select(*by, F.col("r_value").alias("value"), (F.least("end", "r_end") - F.greatest("start", "r_start") + 1).alias("w")).groupBy(*by, "value").agg(F.sum("w").alias("w"))
    total = Window.partitionBy(*by)
    upto = total.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    c = runs.withColumn("n", F.sum("w").over(total)).withColumn("c", F.sum("w").over(upto))
    at = lambda k: F.min(F.when(F.col("c") >= k, F.col("value")))  # noqa: E731  value at the k-th base
    med = c.groupBy(*by).agg(F.max("n").cast("long").alias("valid_bp"), at(F.floor((F.col("n") + 1) / 2)).alias("lo"), at(F.floor(F.col("n") / 2) + 1).alias("hi"))
    return size.join(med, by, "left").select(*by, "total_bp", F.coalesce("valid_bp", F.lit(0)).cast("long").alias("valid_bp"), ((F.col("lo") + F.col("hi")) / 2).alias("median"))


def junctions(exons: DataFrame) -> DataFrame:
    """1-bp exon junctions per transcript: all exons but the last in transcript order; the exon's 3' end. One exon has none."""
    w = Window.partitionBy("tx")
    last = F.max("rank").over(w)
    return exons.withColumn("_last", last).filter(F.col("rank") < F.col("_last")).select("tx", "chrom", "strand", "rank", F.when(F.col("strand") == "+", F.col("end")).otherwise(F.col("start")).alias("junction"))


def nearest_downstream_junction(variants: DataFrame, junction: DataFrame) -> DataFrame:
    """Per variant row (id, tx, pos): the next junction of its transcript behind it, by strand; null where none is."""
    j = junction.select("tx", "strand", "junction")
    ahead = variants.join(j, "tx").groupBy("id", "tx", "pos").agg(
        F.min(F.when((F.col("strand") == "+") & (F.col("junction") > F.col("pos")), F.col("junction"))).alias("plus"),
        F.max(F.when((F.col("strand") == "-") & (F.col("junction") < F.col("pos")), F.col("junction"))).alias("minus"),
        F.first("strand").alias("strand"),
    )
    return ahead.select("id", "tx", "pos", "strand", F.coalesce("plus", "minus").alias("junction"))


def ejc_windows(nearest: DataFrame, centre: int = 24, reach: int = 15) -> DataFrame:
    """[target - reach, target + reach) around the junction's upstream ``centre``, as inclusive intervals."""
    target = F.when(F.col("strand") == "+", F.col("junction") - centre).otherwise(F.col("junction") + centre)
    return nearest.filter("junction IS NOT NULL").withColumn("start", target - reach).withColumn("end", target + reach - 1)


def take_first_bases(blocks: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first ``n`` transcript bases of blocks (rank, start, end, strand), the last block trimmed on its 3' side."""
    before = F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = blocks.withColumn("_left", F.lit(n) - before).filter("_left > 0")
    size = F.least(F.col("_left"), F.col("end") - F.col("start") + 1)
    plus = F.col("strand") == "+"
    sized = left.withColumn("_size", size)
    ends = {"start": F.when(plus, F.col("start")).otherwise(F.col("end") - F.col("_size") + 1), "end": F.when(plus, F.col("start") + F.col("_size") - 1).otherwise(F.col("end"))}
    return sized.withColumns(ends).drop("_left", "_size")
