"""LM scoring by masked pseudo-likelihood: a window network predicts every token from both sides.

The vocabulary comes from word counts over all documents; words beyond it fall into hash buckets, where a word's probability
is its bucket's times its share of the bucket's occurrences in all documents (smoothed, with a rest for words that occur
nowhere). The network adds up embeddings of the ``window`` tokens on each side, by place, and a tanh; the output is a softmax
over classes of token ids and one over the ids of a class, so probabilities sum to one over vocabulary and buckets. Their biases
start as the logarithms of all documents' counts: an untrained network is the unigram table, and training adds what the
neighbours tell.

It is trained in numpy, with AdaGrad steps, on every token of every document once. Documents are dealt over blocks of about
``BLOCK`` tokens by a hash of their id and text, and blocks over rounds. Each block of a round starts from the same weights
and goes through its documents in a fixed order; the blocks' weights are averaged by their numbers of steps, as fixed-point integers,
whose sums don't depend on their order. So neither partitions nor tasks have a part in the result, and more data means more
blocks of the same size. A document's score is the sum of the log-probabilities of its tokens, each given its neighbours.

Edge cases: null and empty texts have no tokens and a sum of 0; places beyond a text's ends are a token of their own; repeated
rows are scored each; an empty table gives no row; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ptclake.llm.common import discard, materialize, scratch, slices, split_words, texts_of, word_hashes

#: What is added to each word's count within its bucket; a word that occurs nowhere has this alone.
SEEN = 0.5
#: At most so many words' counts are sent to the tasks; the counts of all others stay on Spark and are joined.
FREQUENT = 1 << 16
#: Tokens of a training block, about; and tokens of a training step.
BLOCK, STEP = 1 << 20, 1 << 13
#: Weights are averaged as integers of this unit.
UNIT = 2.0**-24


@dataclass(frozen=True)
class Shape:
    """Sizes of the network: ``classes * members`` token ids, the last quarter of them hash buckets."""

    classes: int = 64
    members: int = 64
    width: int = 16
    window: int = 2

    @property
    def ids(self) -> int:
        return self.classes * self.members

    @property
    def words(self) -> int:
        return self.ids - self.ids // 4

    @property
    def sizes(self) -> tuple[tuple[int, ...], ...]:
        """Embeddings by place (the last row stands for no token), their bias, classes and their biases, members and theirs."""
        return (2 * self.window, self.ids + 1, self.width), (self.width,), (self.width, self.classes), (self.classes,), (self.classes, self.members, self.width), (self.classes, self.members)

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.sizes)

    def parts(self, w: np.ndarray) -> list[np.ndarray]:
        """Views of one array of weights."""
        out, a = [], 0
        for s in self.sizes:
            n = int(np.prod(s))
            out.append(w[a : a + n].reshape(s))
            a += n
        return out

    def start(self, counts: np.ndarray | None = None) -> np.ndarray:
        """All weights in one array, before training: those of the unigram table of ``counts`` by token id."""
        w = np.zeros(self.size, np.float32)
        embeddings, _, _, class_bias, _, member_bias = self.parts(w)
        embeddings[:] = np.random.default_rng(7).normal(0, 0.1, embeddings.shape)
        n = (np.ones(self.ids) if counts is None else counts + SEEN).reshape(self.classes, self.members)
        of_class = n.sum(axis=1)
        class_bias[:], member_bias[:] = np.log(of_class / of_class.sum()), np.log(n / of_class[:, None])
        return w


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each lower-cased word occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                _, codes, words = split_words(texts_of(b), lower=True)
                n = np.bincount(codes, minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], names=["word", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: int) -> list[tuple[str, int]]:
    """The most frequent words with their counts, ties by the word: all words above a count (by eighths of octaves), at most ``size``.

    Only counts of counts and the words themselves go to the driver, at any number of partitions.
    """
    level = F.floor(8 * F.log2("n")).cast("int")
    left, least = size, None
    for k, n in sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("k")).count().collect()), reverse=True):  # a row per eighth of an octave
        left -= n
        if left < 0:
            break
        least = k
    if least is None:
        return []
    found = [(r[0], r[1]) for r in counts.filter(level >= least).collect()]  # at most `size` rows
    return sorted(found, key=lambda x: (-x[1], x[0]))


def vocabulary(docs: DataFrame, shape: Shape) -> list[str]:
    """The most frequent lower-cased words over all documents, ties by the word; at most ``shape.words``."""
    return [w for w, _ in most_frequent(word_counts(docs), FREQUENT)[: shape.words]]


def id_totals(counts: DataFrame, words: list[str], shape: Shape) -> np.ndarray:
    """Per token id (row 0) its occurrences in all documents and (row 1) how many different words have it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sums = TokenIds(words, shape), np.zeros((2, shape.ids), np.int64)
        for b in batches:
            ids = tokens.of_words(b.column(0))
            sums[0] += np.bincount(ids, weights=b.column(1).to_numpy(), minlength=shape.ids).astype(np.int64)
            sums[1] += np.bincount(ids, minlength=shape.ids)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape.ids)), pa.array(sums[0]), pa.array(sums[1])], names=["id", "n", "words"])

    out = np.zeros((2, shape.ids))
    for i, *n in counts.mapInArrow(deal, "id long, n long, words long").groupBy("id").agg(F.sum("n"), F.sum("words")).collect():  # a row per token id
        out[:, i] = n
    return out


class TokenIds:
    """Words to ids: place in the vocabulary, else a hash bucket."""

    def __init__(self, words: list[str], shape: Shape):
        self.known, self.shape = {w: i for i, w in enumerate(words)}, shape

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, codes, words = split_words(texts, lower=True)
        return offsets, self.of_words(words)[codes]

    def of_words(self, words: pa.Array) -> np.ndarray:
        buckets = (word_hashes(words) % np.uint64(self.shape.ids - self.shape.words)).astype(np.int64) + self.shape.words
        listed = words.to_numpy(zero_copy_only=False)
        table = np.fromiter((self.known.get(w, -1) for w in listed), np.int64, len(listed))
        return np.where(table < 0, buckets, table)


def padded(offsets: np.ndarray, ids: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts in a row with ``window`` places of ``shape.ids`` around each, and the places of the ids there."""
    at = np.arange(len(ids)) + shape.window * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    row = np.full(len(ids) + shape.window * len(offsets), shape.ids, np.int64)
    row[at] = ids
    return row, at


def contexts(row: np.ndarray, at: np.ndarray, shape: Shape) -> np.ndarray:
    """Neighbours (2 * window, len(at)) of the tokens at places ``at`` of a padded row."""
    return np.stack([row[at + d] for d in (*range(-shape.window, 0), *range(1, shape.window + 1))])


def _hidden(parts: list[np.ndarray], near: np.ndarray) -> np.ndarray:
    h = parts[1] + parts[0][0].take(near[0], axis=0)
    for k in range(1, len(near)):
        h += parts[0][k].take(near[k], axis=0)
    return np.tanh(h, out=h)


def _by_class(shape: Shape, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of tokens by class, and where each class begins in it."""
    of = target // shape.members
    order = np.argsort(of.astype(np.uint16), kind="stable")
    return order, np.searchsorted(of[order], np.arange(shape.classes + 1))


def log_probabilities(w: np.ndarray, shape: Shape, near: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(target | neighbours) of each token."""
    parts, out = shape.parts(w), np.zeros(len(target), np.float32)
    _, _, classes, class_bias, members, member_bias = parts
    for a in range(0, len(target), STEP):
        order, cuts = _by_class(shape, target[a : a + STEP])
        t = target[a : a + STEP][order]
        h = _hidden(parts, near[:, a : a + STEP][:, order])
        z = np.clip(h @ classes + class_bias, -80, 80)
        logs = z[np.arange(len(t)), t // shape.members]
        np.exp(z, out=z)
        logs -= np.log(z @ np.ones(shape.classes, np.float32))
        for k in range(shape.classes):
            i, j = cuts[k], cuts[k + 1]
            if i < j:
                y = np.clip(h[i:j] @ members[k].T + member_bias[k], -80, 80)
                logs[i:j] += y[np.arange(j - i), t[i:j] % shape.members]
                np.exp(y, out=y)
                logs[i:j] -= np.log(y @ np.ones(shape.members, np.float32))
        out[a + order] = logs
    return out


def train_step(w: np.ndarray, seen: np.ndarray, shape: Shape, near: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One AdaGrad step up the summed log-probabilities, in place; ``seen`` has the sums of squared gradients."""
    parts, n = shape.parts(w), len(target)
    squares, dim = shape.parts(seen), shape.width
    _, _, classes, class_bias, members, member_bias = parts
    order, cuts = _by_class(shape, target)
    near, target = near[:, order], target[order]
    h, one = _hidden(parts, near), np.ones(max(n, shape.classes, shape.members), np.float32)

    def gradient(z: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Of scores z: the targets minus the softmax, in place."""
        np.exp(np.clip(z, -80, 80, out=z), out=z)
        z *= (-1 / (z @ one[: z.shape[1]]))[:, None]
        z.ravel()[np.arange(len(z)) * z.shape[1] + hit] += 1
        return z

    def move(weights: np.ndarray, squares: np.ndarray, g: np.ndarray) -> None:
        squares += g * g
        weights += rate * g / np.sqrt(squares)

    g = gradient(h @ classes + class_bias, target // shape.members)
    back = g @ classes.T
    steps = [(classes, squares[2], h.T @ g), (class_bias, squares[3], one[:n] @ g)]
    for k in range(shape.classes):
        i, j = cuts[k], cuts[k + 1]
        if i < j:
            g = gradient(h[i:j] @ members[k].T + member_bias[k], target[i:j] % shape.members)
            back[i:j] += g @ members[k]
            steps += [(members[k], squares[4][k], g.T @ h[i:j]), (member_bias[k], squares[5][k], one[: j - i] @ g)]
    back *= 1 - h * h
    steps.append((parts[1], squares[1], one[:n] @ back))
    flat, column = back.ravel(), np.arange(dim)
    for k in range(len(near)):
        g = np.bincount((near[k][:, None] * dim + column).ravel(), weights=flat, minlength=(shape.ids + 1) * dim)
        steps.append((parts[0][k], squares[0][k], g.astype(np.float32).reshape(-1, dim)))
    for s in steps:
        move(*s)


def train_block(w: np.ndarray, shape: Shape, texts: list[np.ndarray], rate: float) -> int:
    """Steps over a block's texts in order, in place; returns their number."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    row, places = padded(offsets, np.concatenate(texts) if texts else np.zeros(0, np.int64), shape)
    seen = np.full(shape.size, 0.1, np.float32)
    for a in range(0, len(places), STEP):
        at = places[a : a + STEP]
        train_step(w, seen, shape, contexts(row, at, shape), row[at], rate)
    return -(-len(places) // STEP)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of weights in integers, by piece; the salt goes."""
    sums: dict[int, list] = {}
    for b in batches:
        for i, n, x in zip(*(b.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
            s = sums.setdefault(i, [0, 0])
            s[0] += n
            s[1] = s[1] + np.frombuffer(x, np.int64)
    for i, (n, x) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([0]), pa.array([n]), pa.array([x.tobytes()], pa.binary())], names=["i", "salt", "n", "w"])


def train(docs: DataFrame, words: list[str], totals: np.ndarray, shape: Shape, rounds: int = 4, rate: float = 0.2) -> np.ndarray:
    """Weights after ``rounds`` of blocks, each followed by averaging; every token of ``docs`` is a target once.

    ``totals`` has the occurrences by token id, which give the first weights and the number of blocks. Rows that repeat both id and text are dealt to
    one block; a block is cut behind the text with which it has twice its size, so memory follows neither such rows nor a hot block.
    """
    spark, w = docs.sparkSession, shape.start(totals)
    blocks = max(1, -(-int(totals.sum()) // BLOCK))
    turn = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = docs.filter("text IS NOT NULL").select(F.col("text").cast("string"), F.pmod(turn, F.lit(blocks)).alias("block"), F.pmod(F.xxhash64(turn), F.lit(2**62)).alias("turn"))
    piece, kind = 1 << 14, "<u2" if shape.ids < 1 << 16 else "<u4"
    known = spark.sparkContext.broadcast(words)

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenIds(known.value, shape)
        for batch in batches:
            for b in slices(batch):
                offsets, ids = tokens.of(texts_of(b))
                ids = ids.astype(kind)
                cut = [ids[i:j].tobytes() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(cut, pa.binary())], names=["block", "turn", "ids"])

    # texts are read once; a round reads the ids of its own blocks
    ids = dealt.mapInArrow(to_ids, "block long, turn long, ids binary").withColumn("round", (F.col("block") % rounds).cast("int"))
    path = scratch(spark, "lm-ids")
    ids.write.partitionBy("round").parquet(path)
    ids = spark.read.schema(ids.schema).parquet(path)
    ids.scratch_path = path
    for k in range(min(rounds, blocks)):
        sent = spark.sparkContext.broadcast(w)

        def local(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            start = sent.value
            total, n, last, texts, held = np.zeros(shape.size, np.int64), 0, None, [], 0

            def done() -> int:
                own = start.copy()
                steps = train_block(own, shape, texts, rate)
                if steps:
                    total[:] += steps * np.rint(own.astype(np.float64) / UNIT).astype(np.int64)
                return steps

            for b in batches:
                for block, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                    if block != last or held >= 2 * BLOCK:
                        n += done() if texts else 0
                        last, texts, held = block, [], 0
                    texts.append(np.frombuffer(ids, kind).astype(np.int64))
                    held += len(texts[-1])
            n += done() if texts else 0
            if n:
                salt = TaskContext.get().partitionId() % 64
                for i in range(0, len(total), piece):
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([salt]), pa.array([n]), pa.array([total[i : i + piece].tobytes()], pa.binary())], names=["i", "salt", "n", "w"])

        ordered = ids.filter(F.col("round") == k).drop("round").repartition("block").sortWithinPartitions("block", "turn", "ids")
        schema = "i long, salt long, n long, w binary"
        # tasks' sums are added up in two steps, so that no task holds those of all others
        sums = ordered.mapInArrow(local, schema).repartition("i", "salt").mapInArrow(_added, schema).repartition("i").mapInArrow(_added, schema)
        new = w.copy()
        for i, _, n, x in sums.collect():  # the network's size
            new[i : i + piece] = np.frombuffer(x, np.int64) / n * UNIT
        w = new
        sent.unpersist()
    discard(ids)
    return w


def score(docs: DataFrame, words: list[str], w: np.ndarray, shape: Shape, counts: DataFrame | None = None, totals: np.ndarray | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, log_likelihood (the sum over its tokens) and mean_log_likelihood (null without tokens).

    A word outside of the vocabulary has the probability of its bucket times its share in it, (n + SEEN) over the sum of this
    for the bucket's words and SEEN for words that occur nowhere; n is from ``counts`` (by default of ``docs``; 0 for words
    not in it). The frequent words' counts are sent to the tasks; all others are joined.
    """
    counts = materialize(word_counts(docs), "lm-words") if counts is None else counts
    totals = id_totals(counts, words, shape) if totals is None else totals
    frequent = dict(most_frequent(counts, FREQUENT))
    shares = (totals[0] + SEEN * (totals[1] + 1))[shape.words :]
    sent = docs.sparkSession.sparkContext.broadcast((words, w, shares, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w, shares, frequent = sent.value
        tokens, row = TokenIds(words, shape), TaskContext.get().partitionId() << 40
        for batch in batches:
            for b in slices(batch):
                offsets, codes, distinct = split_words(texts_of(b), lower=True)
                table = tokens.of_words(distinct)
                ids = table[codes]
                n_of = np.fromiter((frequent.get(x, 0) for x in distinct.to_numpy(zero_copy_only=False)), np.float64, len(distinct))
                bucket = np.maximum(table - shape.words, 0)
                share = np.where(table < shape.words, 0.0, np.log((n_of + SEEN) / shares[bucket]))
                rare = (table >= shape.words) & (n_of == 0)  # the join adds log((n + SEEN) / SEEN)
                each = np.zeros(len(ids) + 1)
                stream, places = padded(offsets, ids, shape)
                for a in range(0, len(ids), 4 * STEP):
                    at = places[a : a + 4 * STEP]
                    each[a : a + len(at)] = log_probabilities(w, shape, contexts(stream, at, shape), stream[at]) + share[codes[a : a + len(at)]]
                n = np.diff(offsets)
                sums = np.where(n > 0, np.add.reduceat(each, offsets[:-1]), 0.0)
                asked = np.concatenate([[0], np.cumsum(rare[codes])])[offsets]
                lists = pa.LargeListArray.from_arrays(pa.array(asked), distinct.take(pa.array(codes[rare[codes]]))).cast(pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(n))), b.column(0), pa.array(n), pa.array(sums), lists], names=["row", "doc_id", "n_tokens", "sum", "rare"])
                row += len(n)

    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "row long, doc_id long, n_tokens long, sum double, rare array<string>")
    local = materialize(dealt, "lm-sums")
    asked = local.select("row", F.explode("rare").alias("word")).join(counts, "word").groupBy("row").agg(F.sum(F.log((F.col("n") + SEEN) / SEEN)).alias("more"))
    total = F.col("sum") + F.coalesce("more", F.lit(0.0))
    return local.join(asked, "row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"))


def pseudo_likelihood(docs: DataFrame, shape: Shape = Shape(), **options) -> DataFrame:  # noqa: B008
    """Counts, trains and scores over all of ``docs(doc_id, text)``."""
    counts = materialize(word_counts(docs), "lm-words")
    words = [w for w, _ in most_frequent(counts, FREQUENT)[: shape.words]]
    totals = id_totals(counts, words, shape)
    return score(docs, words, train(docs, words, totals[0], shape, **options), shape, counts, totals)
