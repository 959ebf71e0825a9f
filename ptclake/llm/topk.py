"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

Equal vectors become one point with the ids that can count. Points go to the nearest of a bounded number of centres, fitted on a
bounded sample of the points (``sample_rows``); every point is in a shard, and a centre's points are cut into shards of bounded size by a
hash. A shard's ball tree is built once. A node, and so is a whole centre, is opened only where its upper bound (inner product with the
ball's centre, and the query's norm times the radius) can beat the query's kth score. That score is shared between shards in waves:
a query first searches one shard of its most promising centre, then the rest of its best ``FEW`` centres, then all others that its kth
score so far leaves; a query isn't sent to shards it can't gain from, and a shard's tree is copied only as often as its own
queries fill blocks.

Components become floor(scale * x); scores are exact integers: floating point is used only below 2**53, else 64-bit integers.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part; only vectors of equal dimension
meet; a null id takes no part; repeated rows are candidates each (those with the query's id never for that query); with
fewer than k candidates all are returned; ties go to the smaller id; an empty table gives no row; further columns are left out.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ptclake.llm.common import discard, materialize

#: Centres of the second wave, the first one's included.
FEW = 4


class BallTree:
    """Balls over the rows of an integer matrix; leaves of at most ``leaf`` rows."""

    def __init__(self, points: np.ndarray, leaf: int = 32):
        self.points = points.astype(np.float64)
        self.order = np.arange(len(points))
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []  # centre, radius, from, to, left, right
        work = [(0, len(points), -1, 0)]
        while work:
            a, b, parent, side = work.pop()
            x = self.points[self.order[a:b]]
            centre = x.mean(axis=0)
            away = np.sqrt(((x - centre) ** 2).sum(axis=1))
            me = len(self.nodes)
            self.nodes.append([centre, float(away.max()), a, b, -1, -1])
            if parent >= 0:
                self.nodes[parent][4 + side] = me
            if b - a > leaf and away.max() > 0:
                # two far points; the rest goes by which of them is nearer
                p = x[int(away.argmax())]
                q = x[int(((x - p) ** 2).sum(axis=1).argmax())]
                key = x @ (q - p)
                half = (b - a) // 2
                split = np.argpartition(key, half)
                self.order[a:b] = self.order[a:b][split]
                work += [(a, a + half, me, 0), (a + half, b, me, 1)]


def search(tree: BallTree, ids: np.ndarray, members: np.ndarray, exact: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The best k per query within a shard, as (query row, id, score), and how many pairs of a query and a point were scored.

    ``ids`` of point p are ``ids[members[p]:members[p + 1]]``, in order; ``bound`` is the score below which a
    candidate can't count. All queries that may still gain from a node visit it together.
    """
    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    q = queries.astype(np.float64)
    slack = 1e-9 * (1 + norms) * (1 + max((abs(n[0]).max() + n[1] for n in tree.nodes), default=0.0)) * queries.shape[1]
    top_s = np.full((len(q), k), np.iinfo(np.int64).min)
    top_i = np.full((len(q), k), np.iinfo(np.int64).max)
    low = bound.astype(np.int64).copy()
    small = float(np.abs(q).max(initial=0)) * float(np.abs(tree.points).max(initial=0)) * q.shape[1] < 2.0**53
    # how often a point's most repeated id occurs among its ids: a query's own id takes up at most so many places
    heads = np.union1d(np.flatnonzero(np.diff(ids)) + 1, members[:-1]).astype(np.int64)
    most = np.maximum.reduceat(np.diff(np.append(heads, len(ids))), np.searchsorted(heads, members[:-1]))
    work, scored = [(0, np.arange(len(q)), np.full(len(q), np.inf))], 0
    while work:
        node, who, upper = work.pop()
        who = who[upper >= low[who]]  # the kth score may have risen since
        if not len(who):
            continue
        _, _, a, b, left, right = tree.nodes[node]
        if left < 0:
            rows = tree.order[a:b]
            scored += len(who) * len(rows)
            scores = np.rint(q[who] @ tree.points[rows].T).astype(np.int64) if small else queries[who] @ exact[rows].T
            per = members[rows + 1] - members[rows]
            # of points with more ids than can count, the first k beside the query's own do
            use = np.minimum(per, k + most[rows])
            at = np.repeat(np.arange(len(rows)), use)
            each = ids[np.repeat(members[rows], use) + np.arange(len(at)) - np.repeat(np.cumsum(use) - use, use)]
            s = scores[:, at]
            s = np.where(each[None, :] == query_ids[who][:, None], np.iinfo(np.int64).min, s)
            hit = np.flatnonzero((s >= low[who][:, None]).any(axis=1))
            if len(hit):
                w = who[hit]
                all_s = np.concatenate([top_s[w], s[hit]], axis=1)
                all_i = np.concatenate([top_i[w], np.broadcast_to(each, s[hit].shape)], axis=1)
                all_i = np.where(all_s == np.iinfo(np.int64).min, np.iinfo(np.int64).max, all_i)
                best = np.lexsort((all_i, -all_s.astype(object) if not small else -np.maximum(all_s, -(2**62))), axis=1)[:, :k]
                top_s[w], top_i[w] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_i, best, 1)
                low[w] = np.maximum(low[w], top_s[w, -1])
            continue
        bounds = []
        for c in (left, right):
            centre, radius = tree.nodes[c][0], tree.nodes[c][1]
            bounds.append(q[who] @ centre + norms[who] * radius + slack[who])
        # the child that promises more to more queries goes first (it is popped last-in, first-out)
        first = int(bounds[1].sum() > bounds[0].sum())
        work += [((left, right)[1 - first], who, bounds[1 - first]), ((left, right)[first], who, bounds[first])]
    row, col = np.nonzero(top_i != np.iinfo(np.int64).max)
    return row, top_i[row, col], top_s[row, col], scored


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return vectors.filter(fine).select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def distinct_points(rows: DataFrame, k: int) -> DataFrame:
    """``v, ids``: each vector once, with the k + 1 smallest ids that have it and how often (at most k) each does.

    No more can count: of k + 1 ids at most one is a query's own. The limit acts before the shuffle, so many copies of a vector don't meet.
    """
    counted = rows.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    kept = counted.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    return kept.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))  # at most k + 1


def centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """``count`` centres of the sample by Lloyd's rounds from evenly spread rows."""
    x = sample.astype(np.float64)
    c = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(int)]
    for _ in range(rounds):
        near = nearest(x, c)[0]
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the distance to it."""
    near = ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
    return near, np.sqrt(((x - c[near]) ** 2).sum(axis=1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def _by_dimension(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Dimension, rows and vectors of a batch's rows with equal dimensions."""
    v = batch.column(batch.schema.get_field_index(column))
    dims = np.diff(v.offsets.to_numpy()) if len(v) else np.zeros(0, int)
    for d in np.unique(dims):
        part = batch.filter(pa.array(dims == d))
        yield int(d), part, _matrix(part.column(part.schema.get_field_index(column)))


def dealt_points(points: DataFrame, given: dict[int, np.ndarray]) -> DataFrame:
    """``dim, centre, away, v, ids``: every point with its nearest centre (number 0 for a dimension without any)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part, x in _by_dimension(b, "v"):
                near, away = nearest(x.astype(np.float64), given.get(d, np.zeros((1, d))))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d, np.int32)), pa.array(near.astype(np.int32)), pa.array(away), *part.columns], names=["dim", "centre", "away", *part.schema.names])

    ids = points.schema["ids"].dataType.simpleString()
    return points.mapInArrow(deal, f"dim int, centre int, away double, v array<bigint>, ids {ids}")


def build_trees(shards: DataFrame) -> DataFrame:
    """``dim, centre, part, tree`` from ``dim, centre, part, v, ids``: a shard's points, ids and ball tree as one binary."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        points = _matrix(table.column("v").combine_chunks())
        ids = table.column("ids").combine_chunks()
        pairs = ids.flatten()
        each = pairs.field("n").to_numpy()
        per = np.add.reduceat(each, ids.offsets.to_numpy()[:-1] - ids.offsets.to_numpy()[0])
        tree, out = BallTree(points), io.BytesIO()
        fields = list(zip(*tree.nodes, strict=True))
        np.savez(out, points=points, ids=np.repeat(pairs.field("vec_id").to_numpy(), each), members=np.concatenate([[0], np.cumsum(per)]), order=tree.order, centre=np.array(fields[0]), rest=np.array(fields[1:]).T)
        return pa.table({"dim": [key[0].as_py()], "centre": [key[1].as_py()], "part": [key[2].as_py()], "tree": [out.getvalue()]}, schema=pa.schema([("dim", pa.int32()), ("centre", pa.int32()), ("part", pa.int32()), ("tree", pa.binary())]))

    return shards.groupBy("dim", "centre", "part").applyInArrow(build, "dim int, centre int, part int, tree binary")


def _search_shards(trees: DataFrame, asked: DataFrame, k: int, block_rows: int) -> DataFrame:
    """``query_id, vec_id, score``: the best k of each query in each shard that it asks (``dim, centre, part, query_id, v, bound``)."""
    key = ["dim", "centre", "part"]
    blocks = asked.groupBy(key).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    copies = trees.join(blocks, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    # a shard's queries are dealt over as many blocks as they fill
    dealt = asked.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.col("blocks")).cast("int")).drop("blocks")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(shard) or not len(queries):
            return schema.empty_table()
        x = np.load(io.BytesIO(shard.column("tree")[0].as_py()))
        tree = BallTree.__new__(BallTree)
        tree.points, tree.order = x["points"].astype(np.float64), x["order"]
        tree.nodes = [(c, r[0], *map(int, r[1:])) for c, r in zip(x["centre"], x["rest"].tolist(), strict=True)]
        ids = queries.column("query_id").to_numpy()
        row, vec, score, _ = search(tree, x["ids"], x["members"], x["points"], _matrix(queries.column("v").combine_chunks()), ids, queries.column("bound").to_numpy(), k)
        return pa.table([ids[row], vec, score], schema=schema)

    by = [*key, "block"]
    return copies.groupBy(by).cogroup(dealt.groupBy(by)).applyInArrow(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k per query; a query has at most k rows from each shard."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, shard_rows: int = 4096, block_rows: int = 4096, most_centres: int = 256, sample_rows: int = 16_384) -> DataFrame:
    """The k best candidates of each query (rows whose id is divisible by ``every``): query_id, rank, vec_id, score.

    A shard holds about ``shard_rows`` points and a block about ``block_rows`` queries. There are at most ``most_centres`` centres of a
    dimension, fitted on about ``sample_rows`` points, those with the smallest hashes; only they, not the sizes of shards, are bounded.
    """
    lowest = F.lit(-(2**63)).cast("long")
    rows = integer_vectors(vectors, scale)
    points = materialize(distinct_points(rows, k), "topk-distinct")
    queries = materialize(rows.filter(F.col("vec_id") % every == 0).distinct().select(F.col("vec_id").alias("query_id"), "v"), "topk-queries")
    n = max(1, points.count())
    share = min(1.0, sample_rows / n)
    sample = points.filter(F.pmod(F.xxhash64("v", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").collect()  # about sample_rows
    by_dim: dict[int, list] = {}
    for (v,) in sorted(sample):
        by_dim.setdefault(len(v), []).append(v)
    given = {d: centres(np.array(x), max(1, min(most_centres, int(len(x) / share) // shard_rows))) for d, x in by_dim.items()}
    dealt = materialize(dealt_points(points, given), "topk-points")
    # a row per dimension and centre
    balls = {(d, c): (r, max(1, -(-m // shard_rows))) for d, c, r, m in dealt.groupBy("dim", "centre").agg(F.max("away"), F.count("*")).collect()}
    spark = vectors.sparkSession
    parts = spark.createDataFrame([(d, c, m) for (d, c), (_, m) in balls.items()], "dim int, centre int, parts int")
    shards = dealt.join(F.broadcast(parts), ["dim", "centre"]).withColumn("part", F.pmod(F.xxhash64("v", F.lit("part")), "parts").cast("int"))
    trees = materialize(build_trees(shards.select("dim", "centre", "part", "v", "ids")), "topk-trees")
    discard(points, dealt)
    most = max((sum(1 for d, _ in balls if d == e) for e in {d for d, _ in balls}), default=0)

    def asks(wave: int, first: int, last: int):
        """Rows of the shards that a query asks in a wave: centres ``first`` to ``last`` in the order of its upper bounds, where these reach its kth score."""

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for d, part, x in _by_dimension(b, "v"):
                    own = sorted(c for e, c in balls if e == d)
                    if not own:
                        continue
                    c, x = given.get(d, np.zeros((1, d)))[own], x.astype(np.float64)
                    r, m = (np.array([balls[d, o][j] for o in own]) for j in (0, 1))
                    norms = np.sqrt((x * x).sum(axis=1))[:, None]
                    upper = x @ c.T + norms * r
                    upper += 1e-9 * (1 + norms) * (1 + np.abs(c).max() + r.max()) * d
                    order = np.argsort(-upper, axis=1, kind="stable")
                    bound = part.column(2).to_numpy().astype(np.float64)
                    turn = part.column(0).to_numpy() % (1 << 20)
                    row, at = np.nonzero(np.take_along_axis(upper, order, 1)[:, first:last] >= bound[:, None])
                    centre = order[:, first:last][row, at]
                    # the first wave has one part of the first centre, the second one leaves that out
                    chosen = turn[row] % m[centre]
                    count = m[centre] if wave else np.ones(len(row), int)
                    spread = np.repeat(np.arange(len(row)), count)
                    which = np.arange(len(spread)) - np.repeat(np.cumsum(count) - count, count)
                    which = which if wave else chosen
                    keep = np.ones(len(spread), bool) if wave != 1 else (at[spread] > 0) | (which != chosen[spread])
                    spread, which = spread[keep], which[keep]
                    took = part.take(pa.array(row[spread]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(spread), d, np.int32)), pa.array(np.array(own, np.int32)[centre[spread]]), pa.array(which.astype(np.int32)), *took.columns], names=["dim", "centre", "part", *took.schema.names])

        return ask

    best = None
    for wave, (first, last) in enumerate(((0, 1), (0, FEW), (FEW, None))):
        if wave and first >= most:
            break
        if best is None:
            bounded = queries.withColumn("bound", lowest)
        else:
            bounds = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(lowest).alias("bound"))
            bounded = queries.join(bounds, "query_id", "left").select("query_id", "v", F.coalesce("bound", lowest).alias("bound"))
        asked = materialize(bounded.mapInArrow(asks(wave, first, last), "dim int, centre int, part int, query_id long, v array<bigint>, bound long"), "topk-asked")
        found = _search_shards(trees, asked, k, block_rows)
        new = materialize(_best(found if best is None else found.unionByName(best.drop("rank")), k), "topk-best")
        discard(asked, *([best] if best is not None else []))
        best = new
    discard(trees, queries)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
