"""Exact Jaccard self-join on word n-grams by prefix trees, down to the groups that its links make.

1. N-grams get one global order: by a bounded table of how often their hash buckets occur over all documents, then by hash.
2. Equal sets become one class. A class's prefix is its rarest n-grams, so many that two sets at the threshold must have a few
   (``shared``, and one for each ``spread`` of them) in common there; sets with fewer in common with any others are done.
3. Sets that share a prefix n-gram, and between whose sizes there is no step too wide for a pair, meet in the group of the
   first such document. N-grams that very many documents have are first counted by size, so none of them meets in one task.
4. Groups are cut into blocks of at most ``block`` sets, each a piece of work of its own. One set for each component that a block's own
   links make goes on to the next such round, while these get fewer. Of groups that then still have several components, the sets outside
   of the largest one are held against each other and against all of it, block by block; pairs that are
   known to be in one component need no look. So a group of n near copies takes about n sets in blocks, not n squared pairs.
5. Within a piece of work, the sets of one block are stored from their frequent end in a path-compressed trie. It is walked
   once for all sets of the other block: partial overlaps are shared along a path, and a set leaves a subtree as soon as the
   overlap so far with what remains on both sides can't reach the threshold. Each piece of work returns a spanning
   forest of its links, never all pairs.
6. Components of these links, over classes, give each document its group.

N-grams are compared by 64-bit hashes, sets of equal documents by 128 bits.

Edge cases: a null text or one without words has the empty set and links with nothing; with fewer than n words, the whole
sequence is the one n-gram; ``doc_id`` names a document (repeated rows are one document with its sets' links each; a null id
takes its class's group and else none); an empty table gives no row; further columns are left out.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ptclake.llm.common import discard, materialize, mix, slices, split_words, texts_of, word_hashes
from ptclake.llm.components import components

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLICE_BITS = 16
#: N-grams whose bucket occurs more often than so many times are counted by size first.
HOT = 1 << 18
#: Joins with counts of very frequent n-grams go to so many tasks for each n-gram and size.
SALT = 16


def ngram_sets(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Offsets per text and the sorted distinct hashes of its word n-grams."""
    offsets, codes, words = split_words(texts, lower=True)
    h = word_hashes(words)[codes]
    count = np.diff(offsets)
    at = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        at = at * _STEP + h[k : k + len(at)]
    at = mix(at)
    sets = []
    for a, c in zip(offsets[:-1].tolist(), count.tolist(), strict=True):
        if c >= n:
            x = np.sort(at[a : a + c - n + 1])
            sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif c:
            x = np.uint64(c)
            with np.errstate(over="ignore"):
                for w in h[a : a + c]:
                    x = x * _STEP + w
            sets.append(mix(np.array([x])))
        else:
            sets.append(at[:0])
    sizes = np.fromiter((len(x) for x in sets), np.int64, len(sets))
    return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(sets) if sets else at[:0]


def bucket_levels(frame: DataFrame, hashes, bits: int) -> np.ndarray:
    """How often each of 2**bits hash buckets occurs, as 4 * log2 of its count (0: never); 2**bits bytes.

    ``hashes`` turns a batch into 64-bit hashes. Counts are added up slice by slice on Spark, first by the tasks' numbers and then in
    all, streaming over the partitions, so no task gets the counts of all others.
    """
    width = 1 << min(_SLICE_BITS, bits)
    names = ["k", "salt", "counts"]

    def row(k: int, salt: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([data], pa.binary())], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, salt = np.zeros(1 << bits, np.uint32), TaskContext.get().partitionId() % 64
        for b in batches:
            for x in hashes(b):
                total += np.bincount((x >> np.uint64(64 - bits)).astype(np.int64), minlength=len(total)).astype(np.uint32)
        for k in range(len(total) // width):
            if (part := total[k * width : (k + 1) * width]).any():
                yield row(k, salt, zlib.compress(part.astype(np.int64).tobytes(), 1))

    def sums_of(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(x), np.int64)
        return sums

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, x in sums_of(batches).items():
            yield row(k, 0, zlib.compress(x.tobytes(), 1))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, x in sums_of(batches).items():
            yield row(k, 0, np.where(x > 0, np.minimum(255, 1 + np.floor(4 * np.log2(np.maximum(x, 1)))), 0).astype(np.uint8).tobytes())

    schema = "k int, salt int, counts binary"
    out = np.zeros(1 << bits, np.uint8)
    for k, _, x in frame.mapInArrow(count, schema).repartition("k", "salt").mapInArrow(add, schema).repartition("k").mapInArrow(finish, schema).collect():  # 2**bits bytes in all
        out[k * width : (k + 1) * width] = np.frombuffer(x, np.uint8)
    return out


def id_hash(ids: pa.Array) -> np.ndarray:
    return mix(ids.drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + _STEP)


class _Node:
    __slots__ = ("children", "edge", "ends", "largest", "rest", "smallest")

    def __init__(self, edge: np.ndarray):
        self.edge, self.children, self.ends = edge, [], []


def build_trie(sets: list[np.ndarray], sizes: np.ndarray) -> _Node:
    """A path-compressed trie of sorted rank arrays; nodes know the sizes and the longest rest below them."""
    root = _Node(np.zeros(0, np.int64))
    stack: list[tuple[_Node, int]] = [(root, 0)]  # the path to the set added last, with the depth at each node's end
    order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
    last = np.zeros(0, np.int64)
    for i in order:
        x = sets[i]
        m = min(len(x), len(last))
        differ = np.flatnonzero(x[:m] != last[:m])
        common = int(differ[0]) if len(differ) else m
        while stack[-1][1] > common:
            node, depth = stack.pop()
            if stack[-1][1] < common:  # the edge is cut where the paths part
                keep = common - stack[-1][1]
                upper = _Node(node.edge[:keep])
                node.edge = node.edge[keep:]
                upper.children.append(node)
                stack[-1][0].children[-1] = upper
                stack.append((upper, common))
        if len(x) > common:
            node = _Node(x[common:])
            stack[-1][0].children.append(node)
            stack.append((node, len(x)))
        stack[-1][0].ends.append(i)
        last = x
    work = [root]
    for node in work:
        work.extend(node.children)
    for node in reversed(work):
        own = sizes[node.ends] if node.ends else None
        node.smallest = min([*(c.smallest for c in node.children), *([own.min()] if node.ends else [])], default=1)
        node.largest = max([*(c.largest for c in node.children), *([own.max()] if node.ends else [])], default=0)
        node.rest = max((len(c.edge) + c.rest for c in node.children), default=0)
    return root


def trie_links(sets: list[np.ndarray], levels: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (i in left, j in right) of sets whose Jaccard similarity is at least ``percent`` in 100.

    ``sets`` are sorted distinct hashes, ``left`` and ``right`` indices of them; ``levels`` orders the n-grams.
    """
    sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    every = np.concatenate(sets)
    grams, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)  # n-grams of one set alone only count in its size
    bits = int(len(levels)).bit_length() - 1
    rank = np.full(len(grams), -1)
    # frequent first: near copies then share their path until the first n-gram that one of them lacks
    rank[shared[np.lexsort((grams[shared], -levels[(grams[shared] >> np.uint64(64 - bits)).astype(np.int64)].astype(np.int64)))]] = np.arange(len(shared))
    ends = np.cumsum(sizes)
    ranks = []
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        r = rank[inverse[a:b]]
        ranks.append(np.sort(r[r >= 0]))
    has = np.zeros((len(shared) + 1, len(left)), np.uint8)
    for k, i in enumerate(left.tolist()):
        has[ranks[i], k] = 1
    # n-grams of each probe from a rank on
    rest = np.zeros((len(shared) + 2, len(left)), np.int32)
    rest[:-1] = np.cumsum(has[::-1], axis=0, dtype=np.int32)[::-1]
    probe, out = sizes[left], []
    root = build_trie([ranks[j] for j in right.tolist()], sizes[right])
    work = [(root, np.arange(len(left)), np.zeros(len(left), np.int32))]
    while work:
        node, alive, overlap = work.pop()
        if len(node.edge):
            overlap = overlap + has[np.ix_(node.edge, alive)].sum(axis=0, dtype=np.int32)
            past = int(node.edge[-1]) + 1
        else:
            past = 0
        most = overlap + np.minimum(rest[past, alive], node.rest)
        n = probe[alive]
        keep = ((100 + percent) * most >= percent * (n + node.smallest)) & (100 * node.largest >= percent * n) & (100 * n >= percent * node.smallest)
        if not keep.all():
            alive, overlap = alive[keep], overlap[keep]
        if not len(alive):
            continue
        for j in node.ends:
            linked = alive[(100 + percent) * overlap >= percent * (probe[alive] + sizes[right[j]])]
            out.extend((int(left[k]), int(right[j])) for k in linked if left[k] != right[j])
        work.extend((c, alive, overlap) for c in node.children)
    return out


def _forest(ids: list[int], links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each linked document with the smallest one that its links reach within this piece of work."""
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        if a != b:
            if ids[a] > ids[b]:
                a, b = b, a
            root[b] = a
    return [(ids[i], ids[find(i)]) for i in range(len(ids)) if ids[find(i)] != ids[i]]


def _bits(n: int, most: int) -> int:
    """Bits of a table with 16 to 32 buckets for each of n things; it has ``2**most`` bytes at most, beyond which it saves less work."""
    return min(most, max(20, (16 * n).bit_length()))


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, bits: int | None = None, filter_bits: int | None = None, block: int = 256, shared: int = 3, spread: int = 50) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id.

    ``bits`` and ``filter_bits`` size two tables of bytes sent to all tasks (order of n-grams; documents that have a
    partner), by default by the number of documents, up to 2**24 and 2**26 bytes: they only save work. Pieces of work hold at
    most two blocks of about ``block`` sets.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = docs.count()
    bits, filter_bits = bits or _bits(rows // 16, 24), filter_bits or _bits(rows, 26)
    levels = spark.sparkContext.broadcast(bucket_levels(docs.select("text"), lambda b: (ngram_sets(texts_of(x), n)[1] for x in slices(b)), bits))
    hot = int(1 + np.floor(4 * np.log2(HOT)))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for b in slices(batch):
                offsets, grams = ngram_sets(texts_of(b), n)
                level = levels.value[(grams >> np.uint64(64 - bits)).astype(np.int64)]
                order = (level.astype(np.uint64) << np.uint64(56)) | (grams >> np.uint64(8))
                signs, chosen, lengths = [], [], []
                for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    size = j - i
                    # n-grams beyond those that a partner must have, and some more: a partner has as many of them, in its prefix too
                    long = size + percent * size // -100 + shared + size // spread if size else 0
                    first = np.argpartition(order[i:j], long - 1)[:long] if 0 < long < size else np.arange(size)
                    chosen.append(first + i)
                    lengths.append(len(first))
                    x = xxhash.xxh3_128_intdigest(memoryview(grams[i:j]).cast("B") if size else b"")
                    signs.append((x >> 64, x & (1 << 64) - 1))
                sign = np.array(signs, np.uint64).view(np.int64).reshape(-1, 2)
                at = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
                # an n-gram that is very frequent even there is marked
                pairs = pa.StructArray.from_arrays([pa.array(grams[at].view(np.int64)), pa.array(level[at] > hot)], names=["gram", "hot"])
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pairs)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(sign[:, 0]), pa.array(sign[:, 1]), lists], names=["doc_id", "size", "sign_a", "sign_b", "prefix"])

    sets = materialize(docs.mapInArrow(keys, f"doc_id long, size long, sign_a long, sign_b long, prefix {_PREFIX}"), "ngram-sets")
    full = sets.filter("size > 0")
    classes = materialize(full.groupBy("sign_a", "sign_b").agg(F.min("doc_id").alias("first")), "ngram-classes")
    members = _members(full, classes, percent, filter_bits, shared, spread)
    roots = _roots(docs, members, levels, n, percent, filter_bits, block)
    # documents of an empty set stand for themselves, others for their class
    named = full.select("doc_id", "size", "sign_a", "sign_b").join(classes, ["sign_a", "sign_b"]).select("doc_id", "size", "first")
    every = named.unionByName(sets.filter("size = 0").select("doc_id", "size", F.col("doc_id").alias("first")))
    return every.join(roots, every["first"] == roots["node"], "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("root", "first").alias("component_id"))


_PREFIX = "array<struct<gram: long, hot: boolean>>"


def _runs(rows: DataFrame, percent: int, shared: int, spread: int) -> DataFrame:
    """``doc_id, pivot, need, times`` of n-grams (gram, size, doc_id) that several documents have; a task has all of an n-gram."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of a batch: whether its run goes on is only seen in the next one
        pivot, several = 0, False  # of the run that the held row belongs to; whether rows before it do too
        for b in itertools.chain(batches, [None]):
            cols = [np.zeros(0, np.int64)] * 3 if b is None else [b.column(k).to_numpy().astype(np.int64) for k in range(3)]
            if held is not None:
                cols = [np.concatenate([[h], c]) for h, c in zip(held, cols, strict=True)]
            g, n, d = cols
            if not len(g):
                continue
            # sets of one n-gram in order of size: a step that is too wide for any pair across it starts another run
            new = np.concatenate([[held is None or not several], (g[1:] != g[:-1]) | (100 * n[:-1] < percent * n[1:])])
            heads = np.concatenate([[pivot], d[new]])
            run = np.cumsum(new)
            pivots = heads[run]
            before = ~new
            after = np.concatenate([~new[1:], [False]])
            use = before | after
            if b is not None:
                use[-1] = False
                held, pivot, several = (g[-1], n[-1], d[-1]), pivots[-1], bool(before[-1])
            least = -(-percent * n // 100)  # a partner's least size, and the least overlap with it
            rows = np.stack([d, pivots, np.minimum(least, shared + least // spread)], axis=1)[use]
            rows, times = np.unique(rows, axis=0, return_counts=True)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(times)], names=["doc_id", "pivot", "need", "times"])

    dealt = rows.repartition("gram").sortWithinPartitions("gram", "size", "doc_id")
    return dealt.mapInArrow(meet, "doc_id long, pivot long, need long, times long")


def _hot_runs(rows: DataFrame, percent: int, shared: int, spread: int) -> DataFrame:
    """As ``_runs``, for n-grams that very many documents have: these meet as counts by size, which each document then looks up."""
    sizes = rows.groupBy("gram", "size").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    by_size = Window.partitionBy("gram").orderBy("size")
    step = F.coalesce(100 * F.lag("size").over(by_size) < percent * F.col("size"), F.lit(True))
    runs = sizes.withColumn("new", step.cast("int")).withColumn("run", F.sum("new").over(by_size))
    whole = Window.partitionBy("gram", "run")
    runs = runs.select("gram", "size", F.min_by("first", "size").over(whole).alias("pivot"), F.sum("n").over(whole).alias("all")).filter("all > 1")
    runs = materialize(runs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), "ngram-hot")
    least = -F.floor(-F.lit(percent) * F.col("size") / 100)
    found = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(runs, ["gram", "size", "salt"])
    return found.groupBy("doc_id", "pivot", F.least(least, shared + F.floor(least / spread)).cast("long").alias("need")).agg(F.count("*").alias("times"))


def _members(full: DataFrame, classes: DataFrame, percent: int, filter_bits: int, shared: int, spread: int) -> DataFrame:
    """``doc_id, pivot, n``: first documents of classes in groups of n > 1 that may have links."""
    spark = full.sparkSession
    some = full.select("doc_id", F.col("size").cast("int").alias("size"), "prefix").filter("doc_id IS NOT NULL")
    # Only first documents of classes count. Most documents share no bucket with a copy and are firsts without a look-up; the others are joined.
    copies = full.select("doc_id", "sign_a", "sign_b").join(classes, ["sign_a", "sign_b"]).filter("doc_id <> first").select("doc_id")
    copied = spark.sparkContext.broadcast(bucket_levels(copies, lambda b: [id_hash(b.column(0))], filter_bits))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(copied.value[(id_hash(b.column(0)) >> np.uint64(64 - filter_bits)).astype(np.int64)] > 0)], names=["doc_id", "size", "prefix", "maybe"])

    def grams_of(rows: DataFrame, hot: bool) -> DataFrame:
        """gram, size, doc_id of the first documents among rows."""
        split = rows.mapInArrow(marked, f"doc_id long, size int, prefix {_PREFIX}, maybe boolean")
        looked = split.filter("maybe").join(classes.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
        each = split.filter("NOT maybe").unionByName(looked).select(F.explode("prefix").alias("p"), "size", "doc_id")
        return each.filter(F.col("p.hot") == hot).select("p.gram", "size", "doc_id")

    met, with_hot = _runs(grams_of(some, False), percent, shared, spread), some.filter(F.exists("prefix", lambda p: p["hot"]))
    if not with_hot.isEmpty():
        met = met.unionByName(_hot_runs(materialize(grams_of(with_hot, True), "ngram-hot-grams"), percent, shared, spread))
    met = materialize(met.groupBy("doc_id", "pivot").agg(F.min("need").alias("need"), F.sum("times").alias("times")), "ngram-met")
    # a document with a link has at least `need` prefix n-grams in common with others; of texts that share an id, the one that needs least counts
    enough = met.groupBy("doc_id").agg(F.min("need").alias("need"), F.sum("times").alias("times")).filter("times >= need").select("doc_id")
    some = materialize(met.join(enough, "doc_id", "left_semi").select("doc_id", "pivot"), "ngram-some")
    discard(met)
    return _sized(some, "ngram-members").filter("n > 1")


def _sized(rows: DataFrame, name: str) -> DataFrame:
    """``doc_id, pivot`` and n, the rows of the pivot's group. Counts are written first, so that the join can split a large group."""
    counts = materialize(rows.groupBy("pivot").agg(F.count("*").alias("n")), f"{name}-counts")
    out = materialize(rows.join(counts, "pivot"), name)
    discard(counts)
    return out


def _roots(docs: DataFrame, members: DataFrame, levels, n: int, percent: int, filter_bits: int, block: int) -> DataFrame:
    """``node, root`` of the first documents of classes that have links, whose root is another one."""
    spark = docs.sparkSession
    partnered = spark.sparkContext.broadcast(bucket_levels(members.select("doc_id"), lambda b: [id_hash(b.column(0))], filter_bits))

    def with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(len(b), bool)
            some = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            keep[some] = partnered.value[(id_hash(b.column(0)) >> np.uint64(64 - filter_bits)).astype(np.int64)] > 0
            yield b.filter(pa.array(keep))

    texts = docs.mapInArrow(with_partner, "doc_id long, text string")
    turn = lambda k, m: F.pmod(F.xxhash64("doc_id", F.lit(k)), m).cast("long")
    found, level, k = [], members, 0
    while True:
        own = level.withColumn("own", turn(k, F.ceil(F.col("n") / block)))
        links = materialize(_pieces(texts, own.select("doc_id", "pivot", F.col("own").alias("a"), F.col("own").alias("b"), "own"), levels, n, percent), "ngram-links")
        found.append(links.select("u", "v"))
        several = own.filter(F.col("n") > block)
        rows = several.count()
        if not rows:
            break
        # a block's forest leads to the smallest set of each of its components, which goes on
        rest = several.join(links.select("pivot", F.col("u").alias("doc_id")), ["pivot", "doc_id"], "left_anti").select("doc_id", "pivot")
        level, k = _sized(rest, f"ngram-level-{k}"), k + 1
        if 2 * level.count() > rows:
            break
    roots = components(functools.reduce(DataFrame.unionByName, found))
    if not k:
        return roots
    # sets outside of their group's largest component against each other and against it
    named = materialize(_labelled(members.filter(F.col("n") > block), roots).select("doc_id", "pivot", "label"), "ngram-labelled")
    sizes = named.groupBy("pivot", "label").agg(F.count("*").alias("m"))
    most = materialize(sizes.groupBy("pivot").agg(F.max_by("label", F.struct("m", "label")).alias("most"), F.sum("m").alias("n"), F.max("m").alias("m")).filter("n > m"), "ngram-largest")
    if most.isEmpty():
        return roots
    cut = named.join(most, "pivot").withColumn("inside", F.col("label") == F.col("most"))
    mixed, pure = F.ceil((F.col("n") - F.col("m")) / block), F.ceil(F.col("m") / block)
    cut = cut.select("doc_id", "pivot", "inside", mixed.alias("mixed"), pure.alias("pure")).withColumn("own", F.when(F.col("inside"), F.col("mixed") + turn(k, F.col("pure"))).otherwise(turn(k, F.col("mixed"))))
    others = F.when(F.col("inside"), F.sequence(F.lit(0).cast("long"), F.col("mixed") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("mixed") + F.col("pure") - 1))
    work = cut.withColumn("other", F.explode(others)).select("doc_id", "pivot", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own")
    more = materialize(_pieces(texts, work, levels, n, percent).select("u", "v"), "ngram-links")
    discard(named, most)
    return components(roots.toDF("u", "v").unionByName(more))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``label``, the smallest document that a row's document is known to be connected with."""
    return rows.join(labels.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("label", F.coalesce("root", "doc_id")).drop("root")


def _pieces(texts: DataFrame, work: DataFrame, levels, n: int, percent: int) -> DataFrame:
    """``pivot, u, v`` by pieces of work (pivot, a, b): of the links between blocks a and b, a forest of each set u to the smallest one v that it reaches."""
    key = ["pivot", "a", "b"]
    dealt = texts.join(work, "doc_id").select(*key, "own", "doc_id", "text").repartition(*key).sortWithinPartitions(*key)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, found = None, [], []

        def done() -> None:
            if len(rows) > 1:
                ids, owns, own_sets = [r[0] for r in rows], np.array([r[1] for r in rows]), [r[2] for r in rows]
                a, b = last[1:]
                left = np.flatnonzero(owns == a)
                if len(left) and (owns == b).any():
                    found.extend((last[0], u, v) for u, v in _forest(ids, trie_links(own_sets, levels.value, left, np.flatnonzero(owns == b), percent)))

        def flush() -> pa.RecordBatch:
            pairs = np.array(found, np.int64).reshape(-1, 3)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(3)], names=["pivot", "u", "v"])

        for batch in batches:
            for b in slices(batch):
                offsets, all_grams = ngram_sets(texts_of(b), n)
                cols = [b.column(k).to_pylist() for k in range(5)]
                for k, (p, x, y, own, doc) in enumerate(zip(*cols, strict=True)):
                    if (p, x, y) != last:
                        done()
                        last, rows = (p, x, y), []
                    rows.append((doc, own, all_grams[offsets[k] : offsets[k + 1]].copy()))
            yield flush()
        done()
        yield flush()

    return dealt.mapInArrow(join, "pivot long, u long, v long")
