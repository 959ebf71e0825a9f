"""Shared helpers of the training-data operators: tables, scratch space, words and ordered positions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text handled at once inside a task; batches with more are cut, so memory doesn't follow batch sizes.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir.

    Where that is unset, only a local master may take a temporary folder: on a cluster, executors would each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for frames that nothing reads any more: all that came from them has been written itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that no column of the frame has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def with_positions(df: DataFrame, keys: list, weight: str | None = None, name: str = "positions", pos: str = "pos", start: str = "start") -> DataFrame:
    """Adds ``pos`` (0-based rank in the order of ``keys``) and, with ``weight``, ``start`` (weights of all rows before).

    The order is made by range partitions, so neither a hot leading key nor the whole table meets in one task as long
    as the keys tell rows apart; only one row per partition is gathered to add up the partitions' totals. Rows
    with equal keys are in any order. Columns of the added names are replaced; all others are kept, whatever their names.
    """
    own = [c for c in df.columns if c not in (pos, *([start] if weight else []))]
    w = F.coalesce(F.col(weight).cast("long"), F.lit(0).cast("long")) if weight else F.lit(0).cast("long")
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), w.alias("w"))
    schema = T.StructType(list(dealt.schema)).add("part", "integer").add("pos", "long").add("start", "long")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos, start = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            ws = b.column(1).to_numpy(zero_copy_only=False)
            ends = start + np.cumsum(ws)
            out = [*b.columns, pa.array(np.full(len(ws), part, np.int32)), pa.array(pos + np.arange(len(ws), dtype=np.int64)), pa.array(ends - ws)]
            yield pa.RecordBatch.from_arrays(out, names=[*b.schema.names, "part", "pos", "start"])
            pos, start = pos + len(ws), int(ends[-1]) if len(ws) else start

    local = materialize(dealt.mapInArrow(number, schema), name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("part").agg(F.count("*").alias("n"), F.sum("w").alias("sum"))
    #: one row per partition of the table, so this side is small at any size of the table
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("s0"))
    added = [(F.col("pos") + F.col("n0")).alias(pos), (F.col("start") + F.col("s0")).alias(start)]
    return local.join(F.broadcast(offsets), "part").select("row.*", *added[: 2 if weight else 1])


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part has at most SLICE_BYTES of text, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths.astype(np.int64)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column as 64-bit strings in buffers of their own, null as the empty text.

    Some Arrow string kernels mistake the offsets of a sliced array, so a slice is copied first.
    """
    own = batch.column(batch.schema.get_field_index(column)).take(pa.array(np.arange(len(batch))))
    return pc.fill_null(own.cast(pa.large_string()), "")


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: offsets per text, a code per word, and the distinct words.

    With ``lower`` A-Z become a-z, other letters stay.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.flatten()
    offsets = offsets - offsets[0]
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        words = words.filter(pa.array(full))
    coded = words.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def lettered(texts: pa.Array, word: bytes) -> pa.Array:
    """Texts with A-Z lower-cased and every ASCII byte outside of ``word`` (other than A-Z) made a space; other characters stay.

    ``texts`` are 64-bit strings in buffers of their own; bytes change in place of their own, so offsets stay.
    """
    change = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in word else 32 for b in range(256))
    _, offsets, data = texts.buffers()
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(change)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash for each distinct word."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words.to_numpy(zero_copy_only=False)), np.uint64, len(words))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length of each range, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def crc_of_runs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each run of little-endian unsigned 32-bit integers."""
    import zlib

    view = memoryview(np.ascontiguousarray(data, "<u4").view(np.uint8))
    return np.fromiter((zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.int64, len(offsets) - 1)
