"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are its word unigrams and bigrams, and the unigrams to trigrams of its words' shapes (letter
case, trailing marks, whether the word repeats the one before), each hashed into ``2**bits`` weights; a text's vector has
mean length one over its features, so long and short texts compare. Training sees at most ``train_rows`` labelled
texts, those with the smallest hash of their id; their hashed features, not their texts, meet in one task. A score is the
logistic function of a sparse dot product.

Edge cases: a null or empty text has no feature and scores by the intercept; labels that are null count as none, several
labels of one document as their mean, 0.5 and above as 1; without any label for training, every score is 0.5; repeated
rows are scored each; an empty table gives no row; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ptclake.llm.common import materialize, mix, slices, split_words, texts_of, word_hashes



def _shape(word: str) -> str:
    """Case and marks of a word: e.g. ``Aa.``, ``AA!!``, ``a***``; the marks alone for words without a letter."""
    letters = word.rstrip("".join(c for c in set(word) if not c.isalnum()))
    tail = word[len(letters) :][:4]
    if not letters:
        return tail
    case = "A" if letters.isupper() and len(letters) > 1 else "Aa" if letters[0].isupper() else "0" if letters.isdigit() else "a"
    return case + tail


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets per text and the weight index of each feature occurrence."""
    offsets, codes, words = split_words(texts)
    counts = np.diff(offsets)
    listed = words.to_numpy(zero_copy_only=False).tolist()
    h = word_hashes(words)[codes]
    shapes = word_hashes(pa.array(list(map(_shape, listed)), pa.large_string()))[codes] if listed else np.zeros(0, np.uint64)
    inner = np.ones(len(codes), bool)
    inner[offsets[:-1][counts > 0]] = False  # words that have one before them in their text
    again = np.concatenate([[False], codes[1:] == codes[:-1]]) & inner if len(codes) else inner
    shapes = np.where(again, shapes * np.uint64(3), shapes)
    before = lambda x, k: np.concatenate([np.zeros(k, x.dtype), x[:-k]])[: len(x)]
    second = np.concatenate([[False], inner[:-1]])[: len(inner)] & inner
    mult, out = np.uint64(0x9E3779B97F4A7C15), []
    salts = np.arange(1, 6, dtype=np.uint64) * mult
    for salt, x, on in zip(salts, (h, before(h, 1) * mult + h, shapes, before(shapes, 1) * mult + shapes, (before(shapes, 2) * mult + before(shapes, 1)) * mult + shapes), (None, inner, None, inner, second), strict=True):
        index = (mix(x + salt) >> np.uint64(64 - bits)).astype(np.int32)
        out.append(index if on is None else np.where(on, index, -1))
    grid = np.stack(out, axis=1).reshape(-1)
    keep = grid >= 0
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets * len(out)]
    return ends, grid[keep]


def train_ftrl(rows: Iterator[tuple[np.ndarray, int]], bits: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights after one pass of per-coordinate FTRL-proximal updates; the last one is the intercept."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(i) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, (np.sign(z[i]) * l1 - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for index, label in rows:
        i, c = np.unique(index, return_counts=True)
        i, x = np.append(i, 1 << bits), np.append(c / np.sqrt((c.astype(float) ** 2).sum()) if len(c) else c.astype(float), 1.0)
        w = weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
        n[i] += g * g
    return weights(slice(None)).astype(np.float32)


def labelled(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """At most ``train_rows`` documents with a label, as (doc_id, text, label, turn): those with the smallest hash of their id."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    # a sort of all labels isn't needed: half as many again as are wanted lie below a bound on the hash
    share = min(1.0, 1.5 * train_rows / max(1, known.count()))
    turn = known.select("doc_id", "label", F.xxhash64("doc_id").alias("turn"))
    low = turn.filter(F.col("turn") <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64))).cast("long"))
    chosen = low.orderBy("turn", "doc_id").limit(train_rows)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")  # at most train_rows rows


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, train_rows: int = 8192, passes: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01) -> np.ndarray:
    """Weights from a bounded sample of labelled rows; ``2**bits + 1`` numbers."""

    def to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                offsets, index = features(texts_of(b), bits)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.ListArray.from_arrays(offsets.astype(np.int32), index)], names=["doc_id", "label", "turn", "index"])

    rows = materialize(labelled(docs, labels, train_rows).select("doc_id", "text", "label", "turn").mapInArrow(to_features, "doc_id long, label int, turn long, index array<int>"), "classifier-features")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["turn", "doc_id"], kind="stable")
        pairs = [(np.asarray(i, np.int64), y) for i, y in zip(group["index"], group["label"], strict=True)]
        w = train_ftrl((p for k in range(passes) for p in pairs[:: 1 if k % 2 == 0 else -1]), bits, alpha, beta, l1, l2)
        some = np.flatnonzero(w)
        return pd.DataFrame({"i": some, "w": w[some]})

    out = np.zeros((1 << bits) + 1, np.float32)
    for i, w in rows.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "i long, w float").collect():  # 2**bits + 1 rows at most
        out[i] = w
    return out


def score(docs: DataFrame, weights: np.ndarray, keep: float | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id and score (0 to 1); with ``keep``, the rows of ``docs`` that score at least so."""
    bits, sent = (len(weights) - 1).bit_length() - 1, docs.sparkSession.sparkContext.broadcast(weights)

    def scores(texts: pa.Array) -> np.ndarray:
        w = sent.value
        offsets, index = features(texts, bits)
        # a dot product with counts is a sum over occurrences; the norm needs the counts
        dots = np.add.reduceat(np.append(w[index], 0.0), offsets[:-1]) * (np.diff(offsets) > 0)
        norms = np.ones(len(texts))
        for k, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if j > i:
                x = np.sort(index[i:j])
                edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
                norms[k] = np.sqrt((np.diff(edges).astype(float) ** 2).sum())
        return (1 / (1 + np.exp(-np.clip(dots / norms + w[-1], -35, 35)))).astype(np.float64)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(texts_of(b)))], names=["doc_id", "score"])

    if keep is not None:
        # rows stand in a column of their own, whatever their columns' names
        carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        at = [c.lower() for c in docs.columns].index("text")

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row = batch.column(0)
                for b in slices(pa.RecordBatch.from_arrays([row, row.field(at).cast(pa.string())], names=["row", "text"])):
                    yield b.select([0]).filter(pa.array(scores(texts_of(b)) >= keep))

        return carried.mapInArrow(choose, carried.schema).select("row.*")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(give, "doc_id long, score double")


def held_out() -> Column:
    """The fold that no label is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Trains on labels outside of the held-out fold and scores every row: doc_id, held_out, score, predicted."""
    weights = train(docs, labels.filter(~held_out()), **options)
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
