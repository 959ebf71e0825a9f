"""Motif scan of region sequences, and the presence matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = np.full(256, 4, np.int64)
_BASE[[*map(ord, "ACGT")]] = range(4)


def score_cutoff(matrix: np.ndarray, p: float, background: tuple[float, ...] = (0.25,) * 4, steps: int = 1000) -> float:
    """The least log-odds score whose chance under the background is below ``p``, on a grid of scores."""
    odds = np.log2(np.maximum(matrix, 1e-4) / np.array(background))
    low, unit = odds.min(axis=1), max((odds.max(axis=1) - odds.min(axis=1)).sum() / steps, 1e-12)
    dist = np.ones(1)
    for row, base in zip(odds, low, strict=True):
        shift = np.rint((row - base) / unit).astype(int)
        new = np.zeros(len(dist) + shift.max())
        for s, b in zip(shift, background, strict=True):
            new[s : s + len(dist)] += b * dist
        dist = new
    tail = np.cumsum(dist[::-1])[::-1]
    k = int(np.argmax(tail < p)) if (tail < p).any() else len(tail)
    return float(low.sum() + k * unit)


def scan_motifs(sequences: DataFrame, motifs: dict[str, np.ndarray], p: float = 1e-4) -> DataFrame:
    """Hits of position weight matrices in ``sequences(id, region, seq)``: id, region, motif, start (1-based), score. N never matches."""
    ready = {m: (np.vstack([np.log2(np.maximum(x, 1e-4) / 0.25).T, np.full((1, len(x)), -1e9)]), score_cutoff(x, p)) for m, x in motifs.items()}

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, region, seq in zip(f["id"], f["region"], f["seq"], strict=True):
                codes = _BASE[np.frombuffer((seq or "").upper().encode("latin-1", "replace"), np.uint8)]
                for m, (odds, least) in ready.items():
                    k = odds.shape[1]
                    if len(codes) < k:
                        continue
                    score = sum(odds[codes[j : len(codes) - k + 1 + j], j] for j in range(k))
                    out.extend((i, region, m, int(a) + 1, float(score[a])) for a in np.flatnonzero(score >= least))
            yield pd.DataFrame(out, columns=["id", "region", "motif", "start", "score"])

    return sequences.select("id", "region", "seq").mapInPandas(scan, "id long, region string, motif string, start long, score double")


def motif_presence(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Hits (id, region, motif) to distinct (id, column) with column ``region.GENE``; a motif without a gene tries its part before ``:``."""
    g = genes.select(F.col("motif").alias("m"), "gene")
    j = hits.join(g, F.col("motif") == F.col("m"), "left").drop("m").join(g.select(F.col("m").alias("m2"), F.col("gene").alias("gene2")), F.substring_index("motif", ":", 1) == F.col("m2"), "left")
    named = j.withColumn("gene", F.coalesce("gene", "gene2")).filter("gene IS NOT NULL")
    return named.select("id", F.concat_ws(".", "region", "gene").alias("column")).distinct()


def motif_matrix(presence: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """0/1 per id and the given columns; ids without a hit are all zero."""
    wide = presence.groupBy("id").pivot("column", columns).agg(F.lit(1))
    return ids.select("id").distinct().join(wide, "id", "left").select("id", *[F.coalesce(f"`{c}`", F.lit(0)).alias(c) for c in columns])
