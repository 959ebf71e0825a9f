"""Mixing sources to target weights by capped water-filling.

Sources share all words by their weights. A source whose share is above ``epochs`` times its size is clamped there, and the
excess goes to the others in proportion to their weights, round by round until no share is above its cap. A round is a sum over the
table of sources; only the words and the weight that are left go to the driver, so the number of sources isn't bounded by it.

Within a source, documents stand in the order of a seeded digest of their ids. All are taken as often as the target holds the whole source,
and then the first ones once more, until the target's words are reached; the last of these is taken in part. So a source's taken words
are its rounded target exactly, and a document is taken at most ``epochs`` times.

Edge cases: null and empty texts have no words and are taken with none; the null source is a source of its own and comes last; a source
without words has a target of 0; null ids are drawn as the empty text; rows that repeat (or share an id) are documents of their own, in any order
among each other; an empty table gives no row; further columns are left out unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ptclake.llm.common import materialize, with_positions

WORDS = r"[^\x20\x09-\x0D]+"


def _over(rest: int, weight: int, epochs: int) -> Column:
    """Whether a source's share of ``rest`` words among ``weight`` is above its cap; exact whole numbers."""
    whole = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    return F.col("weight").cast("decimal(10,0)") * whole(rest).cast("decimal(27,0)") > F.col("source_size").cast("decimal(19,0)") * whole(epochs * weight).cast("decimal(18,0)")


def water_level(sources: DataFrame, epochs: int) -> tuple[int, int, int]:
    """The words and the weight that are left to the sources below their caps, and the rounds that it took.

    ``sources`` has source_size and weight. Clamped sources stay clamped, since the level only rises.
    """
    total, all_weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0)).cast("long")).first()
    rest, weight, rounds = int(total), int(all_weight), 0
    while True:
        over = _over(rest, weight, epochs)
        size, gone = sources.filter(over).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0)).cast("long")).first()
        left = int(total) - epochs * int(size), int(all_weight) - int(gone)
        rounds += 1
        if left == (rest, weight):
            return rest, weight, rounds
        rest, weight = left


def targets(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """Per source of ``sizes(source, source_size)``: its target of words, and ``first``, the words of all sources before it.

    ``weights`` go to the sources by code point, null last, and repeat.
    """
    turns = materialize(with_positions(sizes, [F.col("source").asc_nulls_last()], weight="source_size", name="mix-turns", pos="turn", start="first"), "mix-sources")
    weighed = turns.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int")))
    rest, weight, _ = water_level(weighed, epochs)
    share = (F.col("weight").cast("decimal(10,0)") * F.lit(str(rest)).cast("decimal(27,0)")).cast("double") / float(max(weight, 1))
    return weighed.select("source", "source_size", "first", F.when(_over(rest, weight, epochs), (F.col("source_size") * epochs).cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 13, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, whole (times it is taken as a whole) and part (words of one time more), and the columns of ``keep``."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    sized = materialize(docs.select("doc_id", "source", size.alias("size"), draw.alias("draw"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("kept")), "mix-sizes")
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs).withColumnRenamed("source", "of")
    placed = with_positions(sized, [F.col("source").asc_nulls_last(), F.col("draw"), F.col("doc_id"), F.col("size")], weight="size", name="mix-order")
    x = placed.join(goals, F.col("source").eqNullSafe(F.col("of")))
    words = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target + 0.5) AS BIGINT) div source_size")).otherwise(F.lit(0)).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), words - F.col("whole") * F.col("source_size") - (F.col("start") - F.col("first")))).cast("long")
    out = x.withColumn("whole", whole).withColumn("part", part)
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), "whole", "part", *[F.col("kept")[c].alias(c) for c in keep])


def mixed_texts(mixed: DataFrame) -> DataFrame:
    """The mix itself, from ``mix(..., keep=("text",))``: doc_id, repetition (from 1) and text, a row for each time; the last one may be the document's first words, joined by spaces."""
    times = F.col("whole") + F.when((F.col("part") > 0), 1).otherwise(0)
    rows = mixed.filter((F.col("taken") > 0)).select("doc_id", "text", "whole", "part", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("repetition"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    return rows.select("doc_id", "repetition", F.when(F.col("repetition") <= F.col("whole"), F.col("text")).otherwise(cut).alias("text"))
