"""Importance resampling towards a target: hashed n-gram features, exact weights by bit-sliced aggregation.

A document's bucket counts are kept as bit planes: plane j holds, for each bucket, bit j of its count. The buckets' gains are planes too,
those of the positive and those of the negative ones by themselves. A weight's numerator is the sum over all pairs of planes of
the popcount of their AND, times the power of two that the pair stands for; all whole numbers, so weights are exact. Corpus
counts come from the same planes. What goes to the driver is a number for each bucket.

A feature's checksum is put together from those of its words: a checksum moves on over n further bytes by a linear map, of which
tables are kept for words up to 64 bytes, so runs of words are never written out.

Edge cases: null and empty texts have no words and no features, weight 0, and aren't drawn; null ids are drawn as the empty text and come last
among equal scores; rows that repeat (or share an id) are documents of their own; an empty table gives no row, and
an empty target is a count of 0 in each bucket; further columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ptclake.llm.common import lettered, materialize, slices, split_words, texts_of, with_positions

#: Bytes that words are made of, beside all non-ASCII ones.
LETTERS = bytes([*range(48, 58), *range(97, 123)])
#: Words of up to so many bytes have a table of how checksums move on over them.
NEAR = 64
#: Documents whose planes stand in memory at once.
ROWS = 2048


@cache
def _moves() -> np.ndarray:
    """[length, byte, value]: what each byte of a checksum becomes behind ``length`` zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    at = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    out = [at]
    for _ in range(NEAR):
        out.append((out[-1] >> np.uint32(8)) ^ step[out[-1] & np.uint32(255)])
    return np.stack(out)


def _moved(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    t = _moves()
    byte = np.uint32(255)
    return t[length, 0, crc & byte] ^ t[length, 1, crc >> np.uint32(8) & byte] ^ t[length, 2, crc >> np.uint32(16) & byte] ^ t[length, 3, crc >> np.uint32(24)]


def feature_hashes(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text, and of all runs of 1 to ``order`` words: the text they are in and their CRC-32."""
    offsets, codes, words = split_words(lettered(texts, LETTERS))
    plain = [w.encode() for w in words.to_pylist()]
    crc = np.fromiter(map(zlib.crc32, plain), np.uint32, len(plain))
    length = np.fromiter(map(len, plain), np.int64, len(plain))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(codes))  # words from here to the text's end
    space, one = np.uint32(zlib.crc32(b" ")), np.ones(1, np.int64)
    runs, docs, hashes = crc[codes], [doc], [crc[codes]]
    for k in range(1, order):
        first = np.flatnonzero(left > k)
        behind = codes[first + k]
        if k > 1:
            runs = runs[np.flatnonzero(left[np.flatnonzero(left > k - 1)] > k)]
        else:
            runs = runs[first]
        before, near = _moved(runs, one) ^ space, length[behind] <= NEAR
        runs = _moved(before, np.where(near, length[behind], 0)) ^ crc[behind]
        for i in np.flatnonzero(~near).tolist():
            runs[i] = zlib.crc32(plain[behind[i]], int(before[i]))
        docs.append(doc[first])
        hashes.append(runs)
    return np.diff(offsets), np.concatenate(docs), np.concatenate(hashes)


def count_planes(docs: np.ndarray, buckets: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Planes of the counts of (document, bucket): how many each document has, and all of them in turn, ``width`` 64-bit words each."""
    key, counts = np.unique(docs * (64 * width) + buckets, return_counts=True)
    doc, bucket = np.divmod(key, 64 * width)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, doc, counts)
    n = np.ceil(np.log2(most + 1)).astype(np.int64)
    base = np.cumsum(n) - n
    planes = np.zeros(int(n.sum()) * width, np.uint64)
    for j in range(int(n.max(initial=0))):
        has = np.flatnonzero(counts >> j & 1)
        if len(has):
            place = (base[doc[has]] + j) * width + (bucket[has] >> 6)
            first = np.flatnonzero(np.diff(place, prepend=-1))
            planes[place[first]] = np.bitwise_or.reduceat(np.uint64(1) << (bucket[has] & 63).astype(np.uint64), first)
    return n, planes.reshape(-1, width)


def feature_planes(docs: DataFrame, buckets: int, order: int) -> DataFrame:
    """doc_id, n_words, n_features and planes of every whole text."""
    width = -(-buckets // 64)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in (batch.slice(k, ROWS) for k in range(0, len(batch), ROWS)):
                for b in slices(few):
                    words, doc, crc = feature_hashes(texts_of(b), order)
                    n, planes = count_planes(doc, crc.astype(np.int64) % buckets, len(b), width)
                    offsets = np.concatenate([[0], np.cumsum(n * width * 8)]).astype(np.int32)
                    packed = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(offsets), pa.py_buffer(planes.astype("<u8"))])
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words.astype(np.int64)), pa.array(np.bincount(doc, minlength=len(b)).astype(np.int64)), packed], names=["doc_id", "n_words", "n_features", "planes"])

    return docs.select("doc_id", "text").mapInArrow(make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, planes binary")


def _planes_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All planes of a batch, the row each is of and its place in the row."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    n = np.diff(offsets) // (8 * width)
    data = column.buffers()[2]
    bits = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy().view("<u8").reshape(-1, width) if data else np.zeros((0, width), np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    return bits, row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(k, ROWS) for k in range(0, len(b), ROWS))


def bucket_counts(planes: DataFrame, buckets: int) -> np.ndarray:
    """The occurrences in each bucket over all documents, as sums of planes times powers of two."""
    width = -(-buckets // 64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64 * width, np.int64)
        for b in _parts(batches):
            bits, _, j = _planes_of(b.column(0), width)
            for k in range(int(j.max(initial=-1)) + 1):
                rows = bits[j == k]
                for at in range(0, len(rows), 256):
                    total += np.unpackbits(rows[at : at + 256].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64) << k
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in planes.select("planes").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: the floor of 1000 times the logarithm of its smoothed share in the target over that in the source."""
    s_all, t_all, m = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + m) / (float(s + 1) * float(t_all + m)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of the positive and of the negative gains: [bit, word]."""
    width, bits = -(-len(gain) // 64), int(np.abs(gain).max(initial=0)).bit_length()
    out = []
    for part in (np.maximum(gain, 0), np.maximum(-gain, 0)):
        on = np.zeros((bits, 64 * width), np.uint8)
        on[:, : len(gain)] = part[None, :] >> np.arange(bits)[:, None] & 1
        out.append(np.packbits(on, axis=1, bitorder="little").view("<u8").reshape(bits, width))
    return out[0], out[1]


def importance_weights(docs: DataFrame, target: DataFrame, buckets: int = 10_000, order: int = 2) -> DataFrame:
    """Per document: doc_id, n_words, n_features and weight, the floored mean gain of its features; ``target`` has the texts to resemble."""
    planes = materialize(feature_planes(docs, buckets, order), "resample-planes")
    wanted = feature_planes(target.select(F.lit(0).alias("doc_id"), "text"), buckets, order)
    plus, minus = gain_planes(gains(bucket_counts(planes, buckets), bucket_counts(wanted, buckets)))
    width = -(-buckets // 64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            bits, row, j = _planes_of(b.column(3), width)
            total = np.zeros(len(bits), np.int64)
            for at in range(0, len(bits), 4096):
                own = bits[at : at + 4096]
                for k in range(len(plus)):
                    total[at : at + 4096] += np.bitwise_count(own & plus[k]).sum(1, dtype=np.int64) - np.bitwise_count(own & minus[k]).sum(1, dtype=np.int64) << k
            sums = np.zeros(len(b), np.int64)
            np.add.at(sums, row, total << j)
            n = b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.where(n > 0, sums // np.maximum(n, 1), 0))], names=["doc_id", "n_words", "n_features", "weight"])

    return planes.mapInArrow(weigh, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, seed: int = 7, buckets: int = 10_000, order: int = 2) -> DataFrame:
    """Per document: doc_id, n_features, weight, score and rank; ranks go to ``percent`` of the documents with at least ``least`` words.

    The score adds Gumbel noise by a digest of seed and id to the weight, so the highest scores are a draw without replacement in
    proportion to the weights' exponentials.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    able = F.col("n_words") >= least
    scored = materialize(importance_weights(docs, target, buckets, order).select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), able.alias("able")), "resample-scores")
    drawn = percent * scored.filter("able").count() // 100
    ranked = with_positions(scored, [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], name="resample-ranks")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (F.col("pos") < drawn), F.col("pos") + 1).cast("long").alias("rank"))
