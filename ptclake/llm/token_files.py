"""Token-id files: ORC with run-length-encoded ids, row indexes, and Bloom filters on the document id.

``write_token_ids`` encodes whole texts and writes one row a document in ascending id order; stripes can be read in
parallel, and a look-up by id skips files, stripes and row groups by their statistics and Bloom filters.

Edge cases: a null or empty text is the end id alone; a null ``doc_id`` sorts first and is kept; repeated rows each get
their own row, ordered by id and then by a hash of the text; an empty table gives an empty folder; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ptclake.llm.common import crc_of_runs, materialize, slices, texts_of
from ptclake.llm.tokens import encoder

SCHEMA = "doc_id long, part int, part_start long, ids array<int>"


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_bytes: int = 64 << 20, row_index_stride: int = 10_000) -> None:
    """Writes ``docs(doc_id, text)`` as token ids under ``path``.

    ``part`` numbers the range of ids a row belongs to, in order, and ``part_start`` counts the ids before it there.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in slices(batch):
                offsets, ids = encoder(tokenizer).encode(texts_of(b), end_id)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.full(len(b), part, np.int32)), pa.array(start + offsets[:-1]), pa.ListArray.from_arrays(offsets.astype(np.int32), ids.astype(np.int32))], names=["doc_id", "part", "part_start", "ids"]
                )
                start += len(ids)

    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    (
        ordered.mapInArrow(encode, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", row_index_stride)
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write_token_ids``; files split at stripes."""
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; the filter reaches the ORC reader."""
    return read_token_ids(spark, path).filter(F.col("doc_id").isin(doc_ids))


def token_digests(files: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens and the CRC-32 of its ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(offsets)), pa.array(crc_of_runs(ids.astype("<u4"), offsets))], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    rows = materialize(files.mapInArrow(digest, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"), "token-digests")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    #: one row per part, whatever the number of documents
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
