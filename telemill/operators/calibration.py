"""Scores in [0, 1] by the distribution of training scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.operators.ranking import finite, quantiles, sketch, sketch_grid

GRID = 1001


def fit_ecdf(scores: DataFrame, column: str = "raw_score", size: int = GRID, exact: bool = True, k: int = 8192) -> list[float]:
    """Quantiles at ``size`` even steps, interpolated: exactly, or of a sketch of size ``k`` in one pass (exact up to ``k`` scores, then a rank error of 0.04 %)."""
    if not exact:
        return sketch_grid(scores.agg(sketch(finite(F.col(column)), k).alias("s")), "s", np.linspace(0.0, 1.0, size), k)
    return [r["value"] for r in quantiles(scores, [], column, size).orderBy("i").collect()]  # ``size`` rows


def ecdf(grid: list[float]):
    """A pandas function from raw scores to calibrated ones: linear between grid points, clamped outside, the last
    probability at repeated points, missing stays missing."""
    x = np.array(grid)

    @F.pandas_udf("double")
    def calibrated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in batches:
            yield pd.Series(ecdf_of(raw.to_numpy(float), x))

    return calibrated


def ecdf_of(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Calibrated scores by the grid ``x``."""
    p = np.linspace(0.0, 1.0, len(x))
    at = np.searchsorted(x, v, "right")
    low, high = np.clip(at - 1, 0, len(x) - 1), np.clip(at, 0, len(x) - 1)
    step = np.where(x[high] > x[low], (v - x[low]) / np.where(x[high] > x[low], x[high] - x[low], 1.0), 0.0)
    out = p[low] + np.clip(step, 0, 1) * (p[high] - p[low])
    return np.where(np.isnan(v), np.nan, np.where(v < x[0], 0.0, out))


def ecdf_native(score: Column, grid: list[float]) -> Column:
    """The same as columns, for short grids: counts of the grid points at or under the score."""
    g = F.array(*map(F.lit, grid))
    n = len(grid)
    at = F.size(F.filter(g, lambda v: v <= score))
    low, high = F.element_at(g, F.greatest(at, F.lit(1))), F.element_at(g, F.least(at + 1, F.lit(n)))
    step = F.when(high > low, (score - low) / (high - low)).otherwise(0.0)
    return F.when(score.isNull() | F.isnan(score), score).when(at == 0, 0.0).when(at == n, 1.0).otherwise((at - 1 + step) / (n - 1))
