"""WARC archives and their Merkle fixity audit.

Pages become WARC records; an archive's records have an order and byte offsets. Each replica has a ledger of its own records and
a tree of its own. Where leaves and nodes begin is told by a hash of the page id: ids of which it is divisible by a step begin a
leaf, those of a higher power of the fan-out a node of a higher level. So replicas need not agree on ranges beforehand, a lost
record shifts no other leaf, and ids that clump or lie far apart make no large leaves. A leaf is the hash of its records' ids, offset ranges within the leaf,
and digests, in order; a node that of its children, in order; the top ones are hashed into the root. An audit compares the roots, descends only below nodes that differ
or that one tree lacks, and joins records of the two replicas only in leaves that differ; lost, changed and extra records all come from that descent.

Edge cases: null urls and payloads are empty; a null page id is an id of its own; rows that repeat an id are its first, second ...
copy, by digest; an empty replica loses all records of the other; ids are any 64-bit number; further columns are left out. A leaf with very many records of one
id is hashed in levels of its own, so no list of records is longer than ``fanout``. Payloads may hold anything: files are
read by Content-Length; a url with a line break stands in a field of its own, coded.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ptclake.llm.common import discard, materialize, mix, with_positions

_END = "\r\n\r\n"
_PLAIN_URL = "WARC-Target-URI: "
#: Base64 of a url that holds a line break, which a header line can't.
_CODED_URL = "X-Target-URI-Base64: "


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A resource record with its closing blank lines."""
    payload, url = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    target = F.when(url.rlike("[\r\n]"), F.concat(F.lit(_CODED_URL), F.translate(F.base64(url.cast("binary")), "\r\n", ""))).otherwise(F.concat(F.lit(_PLAIN_URL), url))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\n"), target)
    return F.concat(head, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(_END), payload, F.lit(_END))


def write_warc(pages: DataFrame, path: str, records_per_file: int = 10_000) -> None:
    """Writes ``pages(page_id, url, html)`` as WARC files of a bounded number of records, in ascending page id order over the files."""
    made = record(F.col("page_id"), F.col("url"), F.col("html"))
    body = F.substring(made, F.lit(1), F.char_length(made) - len(_END))  # the line separator closes each record
    pages.repartitionByRange("page_id").sortWithinPartitions("page_id").select(body.alias("value")).write.option("lineSep", _END).option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(content: bytes) -> Iterator[tuple[int | None, str, str]]:
    """Page id, url and payload of a file's records, one after the other by their Content-Length; bytes that aren't UTF-8 become U+FFFD."""
    import base64

    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        head = content[at:end].decode("utf-8", "replace") if end >= 0 else ""
        size = re.search(r"(?i)\r\nContent-Length: *(\d+)", head)
        if not head.startswith("WARC/") or not size or end + 4 + int(size[1]) > len(content):
            raise ValueError(f"no WARC record at byte {at}")
        page = re.search(r"<urn:page:(-?\d+)>", head)
        plain, coded = (re.search(rf"(?i)\r\n{name}([^\r\n]*)", head) for name in (_PLAIN_URL, _CODED_URL))
        url = base64.b64decode(coded[1]).decode() if coded else plain[1] if plain else ""
        start = end + 4
        at = start + int(size[1])
        yield int(page[1]) if page else None, url, content[start:at].decode("utf-8", "replace")
        if content[at : at + 4] not in (b"\r\n\r\n", b""):
            raise ValueError(f"a WARC record's length doesn't match its payload at byte {at}")
        at += 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, html`` of WARC files; a task reads a file at a time, since only lengths from its start on tell where records begin."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for row in parse_warc(content.as_py()):
                    rows.append(row)
                    size += len(row[2])
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(path)
    return files.select("content").mapInArrow(parse, "page_id long, url string, html string")


def records(pages: DataFrame) -> DataFrame:
    """``page_id, length, digest`` of each page's record."""
    made = record(F.col("page_id"), F.col("url"), F.col("html"))
    return pages.select(F.col("page_id").cast("long"), F.octet_length(made).cast("long").alias("length"), F.sha2(made, 256).alias("digest"))


#: The node of records that no marked id precedes, null ids among them.
LOWEST = -(2**63)


def levels_of(replicas: list[DataFrame], fanout: int) -> int:
    """Levels of nodes that suit the larger replica: its count is all that replicas must share."""
    most = max(r.count() for r in replicas)
    return max(1, math.ceil(math.log(max(most, 1), fanout)))


def ledger(replica: DataFrame, levels: int, fanout: int) -> DataFrame:
    """A replica's records in order with their places: marks (the leaf and the nodes above it, each by its first id), i (within the leaf), page_id, length, digest, pos and start (in the archive), offset (in the leaf).

    One pass within range partitions; only counts, lengths and last marks of each partition go over to the next ones.
    """
    keys = [F.col("page_id").asc_nulls_first(), "digest"]
    dealt = replica.select("page_id", F.coalesce("length", F.lit(0)).cast("long").alias("length"), "digest").repartitionByRange(*keys).sortWithinPartitions(*keys)
    step = max(1, fanout // 4)  # a leaf that holds a given record is about twice as long as leaves are on average

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos, start, last = TaskContext.get().partitionId(), 0, 0, np.full(levels, LOWEST, np.int64)
        for b in batches:
            if not len(b):
                continue
            ids, lengths = b.column(0).fill_null(LOWEST).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            hashed = mix(ids.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
            marks = np.stack([np.where(hashed % np.uint64(step * fanout**k) == 0, ids, LOWEST) for k in range(levels)])
            marks = np.maximum(np.maximum.accumulate(marks, axis=1), last[:, None])
            ends = start + np.cumsum(lengths)
            lists = pa.ListArray.from_arrays(np.arange(0, marks.size + 1, levels, dtype=np.int32), marks.T.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(np.full(len(b), part, np.int32)), pa.array(pos + np.arange(len(b))), pa.array(ends - lengths)], names=["page_id", "length", "digest", "marks", "part", "pos", "start"])
            pos, start, last = pos + len(b), int(ends[-1]), marks[:, -1]

    local = materialize(dealt.mapInArrow(scan, "page_id long, length long, digest string, marks array<long>, part int, pos long, start long"), "warc-places")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = local.groupBy("part").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), *[F.max(F.col("marks")[k]).alias(f"m{k}") for k in range(levels)])
    #: a row per partition
    over = each.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "bytes")], F.array(*[F.coalesce(F.max(f"m{k}").over(before), F.lit(LOWEST)) for k in range(levels)]).alias("carried"))
    placed = local.join(F.broadcast(over), "part").select("page_id", "length", "digest", F.zip_with("marks", "carried", lambda x, y: F.greatest(x, y)).alias("marks"), (F.col("pos") + F.col("n0")).alias("pos"), (F.col("start") + F.col("bytes0")).alias("start"))
    placed = placed.withColumn("leaf", F.col("marks")[0])
    first = placed.groupBy("leaf").agg(F.min("pos").alias("p0"), F.min("start").alias("s0"))
    return materialize(placed.join(first, "leaf").select("leaf", "marks", (F.col("pos") - F.col("p0")).alias("i"), "page_id", "length", "digest", "pos", "start", (F.col("start") - F.col("s0")).alias("offset")), "warc-ledger")


def _list_hash(order: str) -> Column:
    """The hash of a group's hashes, in order."""
    return F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct(order, "hash"))), lambda c: c["hash"])), 256)


def tree(book: DataFrame, levels: int, fanout: int) -> list[DataFrame]:
    """Levels ``node, parent, hash`` of a replica's tree from the leaves to the root, each written."""
    line = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "offset", "length", F.coalesce("digest", F.lit("")))
    level = book.select("leaf", "marks", "i", line.alias("hash"))
    most = book.agg(F.max("i")).first()[0] or 0
    while True:  # a leaf with more records than ``fanout`` has levels of its own
        level = level.groupBy("leaf", F.expr(f"i div {fanout}").alias("up")).agg(F.first("marks").alias("marks"), _list_hash("i").alias("hash")).withColumnRenamed("up", "i")
        if most < fanout:
            break
        most //= fanout
    out, nodes = [], level.withColumnRenamed("leaf", "node")
    for k in range(levels):
        parent = F.col("marks")[k + 1] if k + 1 < levels else F.lit(LOWEST)
        nodes = materialize(nodes.select("node", parent.alias("parent"), "marks", "hash"), "warc-nodes")
        out.append(nodes.drop("marks"))
        out[-1].scratch_path = nodes.scratch_path
        nodes = nodes.groupBy("parent").agg(F.first("marks").alias("marks"), _list_hash("node").alias("hash")).withColumnRenamed("parent", "node")
    return [*out, materialize(nodes.select("node", F.lit(LOWEST).alias("parent"), "hash"), "warc-root")]


def differing_leaves(one: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """``node`` of the leaves that differ or that one tree lacks, by descent from the roots below nodes that differ."""
    wrong = None
    for x, y in zip(reversed(one), reversed(other), strict=True):
        if wrong is not None:
            x, y = (z.join(wrong.withColumnRenamed("node", "parent"), "parent", "left_semi") for z in (x, y))
        both = x.select("node", F.col("hash").alias("x")).join(y.select("node", F.col("hash").alias("y")), "node", "full")
        below, above = materialize(both.filter(~F.col("x").eqNullSafe(F.col("y"))).select("node"), "warc-wrong"), wrong
        discard(*([above] if above is not None else []))
        wrong = below
    return wrong


def _numbered(df: DataFrame, keys: list[str], value: Column, into: str) -> DataFrame:
    """``value`` less its least in the group of ``keys`` (null equals null), as ``into``."""
    at = df.withColumn("_v", value)
    first = at.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("_v").alias("_v0"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return at.join(first, on).withColumn(into, F.col("_v") - F.col("_v0")).select(*df.columns, into)


def audit(one: DataFrame, other: DataFrame, fanout: int = 16, depth: int = 3) -> DataFrame:
    """Records of ``one`` that ``other`` has changed or lost, and those that only ``other`` has.

    Both are ``page_id, length, digest``. Records that aren't in both are paired by id, in order of their digests, as changed; the rest are
    lost or extra. Returns page_id, copy, status (changed, lost, extra), archive (of ``fanout ** depth`` records), start, length,
    digest and other_digest; the place is that in ``one``, null for extra records.
    """
    levels = levels_of([one, other], fanout)
    books = [ledger(r, levels, fanout) for r in (one, other)]
    trees = [tree(b, levels, fanout) for b in books]
    wrong = differing_leaves(*trees)
    only = []
    for book in books:
        rows = book.join(wrong, book["leaf"] == wrong["node"], "left_semi")
        only.append(_numbered(_numbered(rows, ["page_id"], F.col("i"), "copy"), ["page_id", "digest"], F.col("i"), "again"))
    a, b = (materialize(x, "warc-suspects") for x in only)
    discard(wrong, *books, *trees[0], *trees[1])
    unpaired = []
    for x, y in ((a, b), (b, a)):
        y = y.select(*[F.col(c).alias(f"y_{c}") for c in ("page_id", "digest", "again")])
        left = x.join(y, F.col("page_id").eqNullSafe(F.col("y_page_id")) & F.col("digest").eqNullSafe(F.col("y_digest")) & (F.col("again") == F.col("y_again")), "left_anti")
        ranked = with_positions(left, [F.col("page_id").asc_nulls_first(), "digest", "again"], name="warc-unpaired", pos="rank")
        unpaired.append(_numbered(ranked, ["page_id"], F.col("rank"), "turn"))
    x, y = (d.alias(k) for d, k in zip(unpaired, "xy", strict=True))
    both = x.join(y, F.col("x.page_id").eqNullSafe(F.col("y.page_id")) & (F.col("x.turn") == F.col("y.turn")), "full")
    lacks_one, lacks_other = F.col("x.i").isNull(), F.col("y.i").isNull()
    status = F.when(lacks_one, "extra").when(lacks_other, "lost").otherwise("changed")
    pick = lambda c: F.when(lacks_one, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(c)
    return both.select(pick("page_id"), pick("copy"), status.alias("status"), F.expr(f"x.pos div {fanout**depth}").alias("archive"), F.col("x.start").alias("start"), pick("length"), F.col("x.digest").alias("digest"), F.col("y.digest").alias("other_digest"))
