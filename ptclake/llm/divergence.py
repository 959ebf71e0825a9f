"""Source divergence audit by count-level bitmaps.

Per language, every source's smoothed term distribution is set against those of the other sources and of the language. A term's share depends
only on its count in the group, so a group keeps a bitset of term ids for each count that occurs. For two groups, AND and popcount of two
bitsets give how many terms have that pair of counts (a joint cell), which is multiplied by the pair's divergence f; a group's terms with
count 0 are the complement of its other bitsets, and make cells in the same way.

Terms are dealt to chunks by a hash, about 2,048 to a chunk, so a language isn't a task; within a chunk ids follow falling frequency,
so that a 64-bit word of the frequent terms has many counts and the many words of the rare terms have few. Where a language has many sources, chunks
are smaller and pairs are made in tiles of sources. All numbers are whole and exact:
shares are at most 1,000,000,001, and products beyond 64 bits are decimals.

Edge cases: null texts, languages and sources read as empty; a group without terms has all counts 0; a language without kept terms has pairs
with value 0; rows that repeat (or share an id) are documents of their own; equal values rank by the item's UTF-8 bytes; an
empty table gives no row; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ptclake.llm.common import lettered, materialize, slices, split_words, texts_of

#: Bytes that terms are made of, beside all non-ASCII ones.
LETTERS = bytes(range(97, 123))
UNIT = 1_000_000_000
#: Kept terms in a chunk, about.
CHUNK = 2048
#: Groups whose pairs with all others a task adds up.
TILE = 512
#: Cells worked out at once.
CELLS = 1 << 20


def occurrences(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents), added up within slices of batches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                offsets, codes, terms = split_words(lettered(texts_of(b), LETTERS))
                groups = pa.StructArray.from_arrays([b.column(0), b.column(1)], names=["lang", "source"])
                names = pa.array([f"{len(x['lang'])}:{x['lang']}{x['source']}" for x in groups.to_pylist()], pa.large_string()).dictionary_encode()
                group = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(b)), np.diff(offsets))
                each, n = np.unique(doc * len(terms) + codes, return_counts=True)
                in_doc, code = np.divmod(each, max(len(terms), 1))
                key, at, members = np.unique(group[in_doc] * len(terms) + code, return_inverse=True, return_counts=True)
                one = np.unique(group, return_index=True)[1]  # a document of each group
                g, code = np.divmod(key, max(len(terms), 1))
                rows = pa.array(one[g])
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), terms.take(pa.array(code)).cast(pa.string()), pa.array(np.bincount(at, n, minlength=len(key)).astype(np.int64)), pa.array(members.astype(np.int64))], names=["lang", "source", "term", "n", "docs"])

    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    return named.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (n + 1) / (total + terms))."""
    return F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), (total + terms).cast("decimal(20,0)")).cast("long") + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs(chunk: pa.Table, size: int, most: int) -> pa.Table:
    """Sums of f over a chunk's terms for a tile of its groups against all of them, from the joint cells of their bitsets.

    ``size`` groups are a tile, and at most about ``most`` cells are worked out at once. Rows have turn (the group's number), block, p and word; a row without a word is a group's share of count 0.
    """
    group, block, p = (chunk.column(c).to_numpy() for c in ("turn", "block", "p"))
    level = chunk.column("word").is_valid().to_numpy()
    word = chunk.column("word").fill_null(0).to_numpy().view(np.uint64)
    s, low = int(group.max()) + 1, int(chunk.column("tile")[0].as_py()) * size
    high = min(s, low + size)
    none = np.zeros(s, np.int64)  # the share of count 0 of each group
    none[group[~level]] = p[~level]
    order = np.lexsort((group, block))
    order = order[level[order]]
    value = np.zeros((high - low, s), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(block[order])) + 1).tolist(), len(order)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        rows = order[a:b]
        seen = np.zeros(s, np.uint64)
        np.bitwise_or.at(seen, group[rows], word[rows])
        rest = np.bitwise_or.reduce(word[rows]) & ~seen  # terms of the block that a group doesn't have
        g, q, w = np.concatenate([group[rows], np.arange(s)]), np.concatenate([p[rows], none]), np.concatenate([word[rows], rest])
        by = np.argsort(g, kind="stable")
        g, q, w = g[by], q[by], w[by]
        starts = np.searchsorted(g, np.arange(s))
        first, end = np.searchsorted(g, [low, high])
        step = max(1, most // len(g))
        for i in range(first, end, step):
            j = min(i + step, end)
            cells = np.bitwise_count(w[i:j, None] & w[None, :]).astype(np.int64)
            d = q[i:j, None] - q[None, :]
            np.add.at(value, g[i:j] - low, np.add.reduceat(cells * (d * d // q[None, :]), starts, axis=1))
    x, y = np.nonzero(np.arange(low, high)[:, None] != np.arange(s)[None, :])
    lang = pa.array([chunk.column("lang")[0].as_py()] * len(x), pa.string())
    return pa.Table.from_arrays([lang, pa.array((x + low).astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(value[x, y])], names=["lang", "turn", "other", "value"])


def divergence(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value and rank: part ``pair`` for each other source of the language, part ``term`` for the ``top`` terms that the source has more of than the language.

    Kept are terms of at least ``least`` documents of the language.
    """
    counts = materialize(occurrences(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    of_term = Window.partitionBy("lang", "term")
    spread = counts.withColumn("lang_n", F.sum("n").over(of_term)).withColumn("lang_docs", F.sum("docs").over(of_term)).withColumn("place", F.row_number().over(of_term.orderBy("source")))
    cells = materialize(spread.filter(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n", (F.col("place") == 1).cast("long").alias("new")), "divergence-cells")
    langs = cells.groupBy("lang").agg(F.sum("new").alias("terms"), F.sum("n").alias("lang_total"))
    occurring = docs.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).agg(F.lit(0).alias("_")).drop("_")
    groups = occurring.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    filled = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms", "lang_total")])
    in_lang = Window.partitionBy("lang")
    filled = filled.withColumn("turn", (F.row_number().over(in_lang.orderBy("source")) - 1).cast("int")).withColumn("sources", F.count("*").over(in_lang))
    # with many sources a chunk has fewer terms, and its pairs are made tile by tile, so a task's rows and sums are bounded
    chunks, tiles = F.ceil(F.col("terms") * F.greatest(F.lit(1.0), F.col("sources") / 1024) / CHUNK).cast("long"), F.ceil(F.col("sources") / TILE).cast("int")
    # a row per language and source; written, so that Spark knows its size and sends it to all tasks only if that is small
    groups = materialize(filled.withColumn("chunks", chunks).withColumn("tiles", tiles).withColumn("none", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms")))), "divergence-groups")

    shared = cells.join(groups.select("lang", "source", "total", "terms", "lang_total", "chunks", "tiles", "turn"), ["lang", "source"])
    shared = shared.withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))
    dealt = shared.select("lang", "turn", "tiles", "term", "p", "lang_n", F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk"))
    ids = dealt.withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy(F.desc("lang_n"), "term")) - 1)
    bitsets = ids.groupBy("lang", "chunk", "turn", "tiles", "p", F.shiftright("id", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, id & 63)")).alias("word"))
    zeros = groups.filter("chunks > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "turn", "tiles", F.col("none").alias("p"), F.lit(0).alias("block"), F.lit(None).cast("long").alias("word"))
    size, most = TILE, CELLS
    tiled = bitsets.unionByName(zeros).select("lang", "chunk", "turn", "block", "p", "word", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    sums = tiled.groupBy("lang", "chunk", "tile").applyInArrow(lambda chunk: _pairs(chunk, size, most), "lang string, turn int, other int, value long").groupBy("lang", "turn", "other").agg(F.sum("value").alias("value"))
    every = groups.select("lang", "source", "turn").join(groups.select("lang", F.col("source").alias("item"), F.col("turn").alias("other")), "lang").filter("turn <> other")
    pairs = every.join(sums, ["lang", "turn", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    more = shared.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    best = Window.orderBy(F.desc("value"), "item")
    own = best.partitionBy("lang", "source")
    # first within thirty-two parts of a group's terms, so that what meets in a task is bounded by ``top``
    few = more.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(32))).withColumn("rank", F.row_number().over(best.partitionBy("lang", "source", "salt"))).filter(F.col("rank") <= top).drop("salt", "rank")
    rank = F.row_number().over(own)
    return pairs.withColumn("rank", rank).unionByName(few.withColumn("rank", rank).filter(F.col("rank") <= top))
