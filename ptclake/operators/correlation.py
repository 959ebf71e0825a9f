"""Pairwise-complete correlations of many columns in one pass, and the pruning by them.

A task turns its rows into matrices of values and of presence, whose cross-products give all pairs' counts, means and co-moments at once. Those
of batches and tasks are merged as central moments, so large means lose no digits. What a task sends on follows the square of the number
of columns, never the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose cross-products are taken at once.
ROWS = 4096
_MOMENTS = ("n", "mean_a", "mean_b", "var_a", "var_b", "cov")


def _of_rows(x: np.ndarray) -> list[np.ndarray]:
    """The six moments of each pair of columns, as matrices [a, b] over the rows that have both."""
    here = np.isfinite(x)
    m = here.astype(np.float64)
    shift = np.where(here, x, 0).sum(0) / np.maximum(m.sum(0), 1)
    z = np.where(here, x - shift, 0)
    n = m.T @ m
    s = z.T @ m / np.maximum(n, 1)  # [a, b]: mean of a, less its shift
    var = np.maximum((z * z).T @ m - n * s * s, 0)
    return [n, s + shift[:, None], (s + shift[:, None]).T, var, var.T, z.T @ z - n * s * s.T]


def _merged(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    n = x[0] + y[0]
    share = y[0] / np.maximum(n, 1)
    da, db, both = y[1] - x[1], y[2] - x[2], x[0] * share
    return [n, x[1] + da * share, x[2] + db * share, x[3] + y[3] + da * da * both, x[4] + y[4] + db * db * both, x[5] + y[5] + da * db * both]


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n and correlation for each two columns (a before b): Pearson's over the ``n`` rows that have both.

    Null, NaN and infinite values are missing. Null for fewer than two rows and where a column doesn't vary in them.
    """
    width = len(columns)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                b = batch.slice(k, ROWS)
                own = _of_rows(np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns], axis=1))
                total = own if total is None else _merged(total, own)
        for a in range(width - 1 if total is not None else 0):
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), *[pa.array([t[a, a + 1 :]], pa.list_(pa.float64())) for t in total]], names=["a", *_MOMENTS])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for i, a in enumerate(b.column(0).to_pylist()):
                own = [c[i].values.to_numpy() for c in b.columns[1:]]
                totals[a] = _merged(totals[a], own) if a in totals else own
        for a, (n, mean_a, mean_b, var_a, var_b, cov) in totals.items():
            varies = (n > 1) & (var_a > n * (1e-12 * mean_a) ** 2) & (var_b > n * (1e-12 * mean_b) ** 2)
            with np.errstate(divide="ignore", invalid="ignore"):
                r = np.clip(cov / np.sqrt(var_a * var_b), -1, 1)
            yield pa.RecordBatch.from_arrays([pa.array([columns[a]] * len(n)), pa.array(columns[a + 1 :]), pa.array(n.astype(np.int64)), pa.array(r, mask=~varies)], names=["a", "b", "n", "correlation"])

    values = df.select([F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    moments = values.mapInArrow(gather, "a int, " + ", ".join(f"{c} array<double>" for c in _MOMENTS))
    return moments.repartition("a").mapInArrow(add, "a string, b string, n long, correlation double")


def strong_pairs(pairs: DataFrame, limit: float = 0.95) -> dict[tuple[str, str], float]:
    """Those of ``correlations`` above the limit; at most a number for each two columns goes to the driver."""
    return {(r["a"], r["b"]): r["correlation"] for r in pairs.filter(F.abs("correlation") > limit).collect()}


def correlation_prune(columns: list[str], corr: dict[tuple[str, str], float], protected: set[str], limit: float = 0.95) -> list[str]:
    """Columns to drop, in order: pairs i < j above the limit; both protected stay, of one protected the other goes, else j. Dropped columns still count."""
    place = {c: k for k, c in enumerate(columns)}
    drop: dict[str, None] = {}
    for a, b in sorted((p for p, c in corr.items() if c is not None and abs(c) > limit), key=lambda p: (place[p[0]], place[p[1]])):
        if not (a in protected and b in protected):
            drop.setdefault(a if b in protected else b)
    return list(drop)
