"""Packing of token sequences: shortest-pack-first over the histogram of lengths.

Documents are cut into pieces of at most ``limit`` ids. Only the histogram of piece lengths (at most ``limit`` bins)
goes to the driver. There, lengths are placed longest first: a length goes to the packing pattern that is fullest
least (the shortest pack) if it fits, else it opens new packs that it fills with its own copies, and only the patterns' counts
change. Once there are as many packs as all ids need, and one in 256 more, a length that fits no pack is cut instead: its first ids (a
multiple of ``GRAIN``) fill the shortest packs, and what is left is a length like others. So documents stay whole where that packs well, and
any histogram packs well. Pieces
then find their places by their rank among the pieces of the same length, which is a join with a table of patterns
whose size follows ``limit``, not the input. Checksums of cut pieces come from those of a piece's prefixes at each multiple of ``GRAIN``.

Edge cases: null and empty texts are one piece with the end id; null ids are kept; repeated rows are packed each;
an empty table gives no row; further columns are left out.
"""

from __future__ import annotations

import heapq
import math
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ptclake.llm.checksums import of_range
from ptclake.llm.common import materialize, slices, texts_of, with_positions
from ptclake.llm.tokens import encoder


#: Pieces are cut at multiples of so many ids.
GRAIN = 32
#: Packs beyond those that all ids need, as a share of them, before pieces are cut.
SLACK = 1 / 256


def pack(histogram: dict[int, int], limit: int, grain: int = 0) -> tuple[list[tuple[list[int], int]], list[tuple[int, int, int]]]:
    """Packing patterns (entries, longest first) and how many packs have each, and cuts (length, ids cut off, pieces).

    An entry is a length, or -1 - k for what the k-th cut takes off. Lengths go longest first into the patterns with the smallest sum; a pattern of
    which only some packs are needed is split in two. The steps follow the number of distinct lengths, not the number of
    pieces. Without a ``grain`` nothing is cut.
    """
    heap: list[tuple[int, int, list[int], int]] = []  # sum, tie-break, entries, packs
    done: list[tuple[list[int], int]] = []
    cuts: list[tuple[int, int, int]] = []
    made = opened = 0
    todo = Counter({k: n for k, n in histogram.items() if n})
    most = math.ceil(sum(k * n for k, n in todo.items()) * (1 + SLACK) / limit) if grain else math.inf
    lengths = [-k for k in todo]
    heapq.heapify(lengths)

    def put(entries: list[int], total: int, packs: int) -> None:
        nonlocal made
        made += 1
        if total >= limit:
            done.append((entries, packs))
        else:
            heapq.heappush(heap, (total, made, entries, packs))

    while lengths:
        length = -heapq.heappop(lengths)
        left = todo.pop(length)
        while left:
            room = limit - heap[0][0] if heap else 0
            if length <= room:
                total, _, entries, packs = heapq.heappop(heap)
                if packs > left:
                    put(entries, total, packs - left)
                    packs = left
                put([*entries, length], total + length, packs)
                left -= packs
            elif opened >= most and grain and room >= grain:  # as many packs as there should be: fill the shortest ones with a part
                total, _, entries, packs = heapq.heappop(heap)
                if packs > left:
                    put(entries, total, packs - left)
                    packs = left
                off = room // grain * grain
                put([*entries, -1 - len(cuts)], total + off, packs)
                cuts.append((length, off, packs))
                if length - off not in todo:
                    heapq.heappush(lengths, off - length)
                todo[length - off] += packs
                left -= packs
            else:  # it doesn't fit the shortest pack: new packs, each as full of this length as those at hand allow
                per = limit // length
                packs = min(left // per, max(1, most - opened))
                if packs:
                    put([length] * per, length * per, packs)
                    opened, left = opened + packs, left - packs * per
                elif left:
                    put([length] * left, length * left, 1)
                    opened, left = opened + 1, 0
    return done + [(entries, packs) for _, _, entries, packs in sorted(heap)], cuts


def pack_histogram(histogram: dict[int, int], limit: int) -> list[tuple[list[int], int]]:
    """Patterns of whole lengths."""
    return pack(histogram, limit)[0]


def pattern_table(patterns: list[tuple[list[int], int]], cuts: list[tuple[int, int, int]] = []) -> list[tuple[int, int, int, int, int, int]]:  # noqa: B006
    """Rows (entry, first rank, last rank, first sequence, copies in a pack, offset of the first copy).

    The pieces of an entry with ranks first..last fill that pattern's packs, ``copies`` next to one another in each.
    """
    rows, ranks, sequence = [], {}, 0
    for entries, packs in patterns:
        offset, i = 0, 0
        while i < len(entries):
            entry, copies = entries[i], 1
            while i + copies < len(entries) and entries[i + copies] == entry:
                copies += 1
            first = ranks.get(entry, 0)
            ranks[entry] = first + copies * packs
            rows.append((entry, first, ranks[entry] - 1, sequence, copies, offset))
            offset, i = offset + copies * (entry if entry > 0 else cuts[-1 - entry][1]), i + copies
        sequence += packs
    return rows


def part_table(histogram: dict[int, int], patterns: list[tuple[list[int], int]], cuts: list[tuple[int, int, int]]) -> list[tuple[int, ...]]:
    """Where the parts of each piece go: rows (length, first rank, last rank, part_start, part_length, shift, sequence, copies, offset).

    Of a length's pieces, the given ones come first and then what cuts of longer ones have left, in the order of the cuts; the first of
    all these are placed whole and the others are cut, again in order. A piece of rank r is number r + shift of its row's places.
    """
    placed: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    for row in pattern_table(patterns, cuts):
        placed[row[0]].append(row)
    whole = {k: rows[-1][2] + 1 for k, rows in placed.items()}
    below, behind = dict(histogram), []  # of each cut, the rank of the first piece that it leaves
    for length, off, n in cuts:
        behind.append(below.get(length - off, 0))
        below[length - off] = behind[-1] + n
    own, ends = defaultdict(list), dict(whole)  # of each length, its cuts and the ranks that they take
    for k, (length, _, n) in enumerate(cuts):
        first = ends.get(length, 0)
        own[length].append((k, first, first + n - 1))
        ends[length] = first + n
    out = []
    for given, n in histogram.items():
        todo = [(given, 0, n - 1, 0, 0)]  # entry, ranks there, how far these are behind those of the given pieces, part_start
        while todo:
            entry, low, high, ahead, start = todo.pop()
            size = entry if entry > 0 else cuts[-1 - entry][1]
            for _, a, b, sequence, copies, offset in placed.get(entry, []):
                x, y = max(a, low), min(b, high)
                if x <= y:
                    out.append((given, x - ahead, y - ahead, start, size, ahead - a, sequence, copies, offset))
            for k, a, b in own.get(entry, []):
                x, y = max(a, low), min(b, high)
                if x <= y:
                    length, off, _ = cuts[k]
                    todo += [(-1 - k, x - a, y - a, ahead - a, start), (length - off, x - a + behind[k], y - a + behind[k], ahead - a + behind[k], start + off)]
    return out


def assign(pieces: DataFrame, limit: int, length: str = "length", order: list[str] | None = None, grain: int = 0) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a length from 1 to ``limit``; ``order`` tells equal lengths apart.

    With a ``grain``, a row may come back in parts, and ``part_start`` and ``part_length`` are added too.
    Further columns are kept, whatever their names; columns of the added names are replaced.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy(F.col(length)).count().collect()}  # at most `limit` rows
    below, base = 0, {}
    for k in sorted(histogram):
        base[k] = below
        below += histogram[k]
    places = [(*r, base[r[0]]) for r in part_table(histogram, *pack(histogram, limit, grain))]
    patterns = spark.createDataFrame(places, "length long, first long, last long, part_start long, part_length long, shift long, sequence long, copies long, offset long, base long")
    added = ["sequence_id", "offset", *(["part_start", "part_length"] if grain else [])]
    kept = [c for c in pieces.columns if c not in added]
    row = pieces.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(length).cast("long").alias("of"))
    ranked = with_positions(row, ["of", *[f"row.{c}" for c in order or kept if c != length]], name="packing-ranks")
    #: patterns follow the number of lengths (at most `limit`), so they are small at any size of the input
    rank = F.col("pos") - F.col("base")
    found = ranked.join(F.broadcast(patterns), (F.col("of") == F.col("length")) & rank.between(F.col("first"), F.col("last")))
    at = rank + F.col("shift")
    parts = ["part_start", "part_length"] if grain else []
    return found.select("row.*", (F.col("sequence") + F.expr("(pos - base + shift) div copies")).alias("sequence_id"), (F.col("offset") + (at % F.col("copies")) * F.col("part_length")).alias("offset"), *parts)


def cut_into_pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, and prefixes: the checksums of its first GRAIN, 2 GRAIN ... ids, four bytes each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                offsets, ids = encoder(tokenizer).encode(texts_of(b), end_id)
                n = np.diff(offsets)
                pieces = -(-n // limit)
                row = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * limit
                length = np.minimum(limit, n[row] - start)
                crc, prefixes = prefix_checksums(ids, offsets[row] + start, length)
                packed = pa.array(prefixes, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc), pa.array(n[row]), packed], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "prefixes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, prefixes binary")


def prefix_checksums(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Of each run of ids its checksum, and those of its prefixes at whole multiples of GRAIN below its length."""
    view, step = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8)), 4 * GRAIN
    whole, out = np.zeros(len(starts), np.int64), []
    for k, (a, n) in enumerate(zip((4 * starts).tolist(), (4 * lengths).tolist(), strict=True)):
        crc, own = 0, array("I")
        for at in range(a, a + n, step):
            crc = zlib.crc32(view[at : min(at + step, a + n)], crc)
            own.append(crc)
        whole[k] = crc
        out.append(own[: (n - 1) // step].tobytes())
    return whole, out


def part_checksums(parts: DataFrame) -> DataFrame:
    """Pieces' parts as pieces of their own: their start, length and checksum in place of the whole piece's, without ``prefixes``."""
    names = [c for c in parts.columns if c not in ("prefixes", "part_start", "part_length")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {c: b.column(k) for k, c in enumerate(b.schema.names)}
            start, size, length, crc = (col[c].to_numpy().copy() for c in ("part_start", "part_length", "length", "ids_crc32"))
            cut = np.flatnonzero(size < length)
            if len(cut):
                prefixes = [array("I", x) for x in col["prefixes"].take(pa.array(cut)).to_pylist()]
                upto = lambda at, k, p: 0 if at == 0 else crc[k] if at == length[k] else p[at // GRAIN - 1]  # noqa: E731, B023
                before, end = (np.array([upto(int(x), k, p) for x, k, p in zip(at[cut], cut, prefixes, strict=True)], np.int64) for at in (start, start + size))
                crc[cut] = of_range(before, end, 4 * size[cut]).astype(np.int64)
            col |= {"start": pa.array(col["start"].to_numpy() + start), "length": pa.array(size), "ids_crc32": pa.array(crc)}
            yield pa.RecordBatch.from_arrays([col[c] for c in names], names=names)

    return parts.mapInArrow(work, T.StructType([f for f in parts.schema.fields if f.name in names]))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, limit: int = 4096) -> DataFrame:
    """Packs whole texts into sequences of at most ``limit`` ids; one row per piece with its sequence and offset."""
    pieces = materialize(cut_into_pieces(docs, tokenizer, end_id, limit), "packing-pieces")
    return part_checksums(assign(pieces, limit, order=["doc_id", "start", "ids_crc32", "doc_tokens"], grain=GRAIN))
