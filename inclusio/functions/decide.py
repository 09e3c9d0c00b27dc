"""Blends and decision rules as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blend(weights, cols) -> Column:
    """sum w_i * p_i, added left to right."""
    return reduce(add, [F.lit(float(w)) * _c(c) for w, c in zip(weights, cols)])


def blend_two(w, a, b) -> Column:
    """w*a + (1-w)*b."""
    return F.lit(float(w)) * _c(a) + F.lit(1.0 - float(w)) * _c(b)


def apply_thresholds(p_med, p_high, t_med, t_high) -> Column:
    """p_high >= t2 -> 2, elif p_med >= t1 -> 1, else 0 (p_low never consulted)."""
    t1 = t_med if isinstance(t_med, Column) else F.lit(float(t_med))
    t2 = t_high if isinstance(t_high, Column) else F.lit(float(t_high))
    return (F.when(_c(p_high) >= t2, F.lit(2)).when(_c(p_med) >= t1, F.lit(1))
            .otherwise(F.lit(0)).cast("bigint"))


def ordinal_decision(p_a, p_b, t_a, t_b) -> Column:
    """p_B >= tB -> 2, elif p_A >= tA -> 1, else 0."""
    return apply_thresholds(p_a, p_b, t_a, t_b)


def argmax_class(*cols) -> Column:
    """Index of the largest probability, first on ties."""
    arr = F.array(*[_c(c) for c in cols])
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("bigint")


def grid_bucket(p, grid: list[float]) -> Column:
    """Number of grid points <= p: p >= grid[j] exactly when bucket > j.

    For an evenly spaced grid the index comes from one division and is then
    corrected by exact comparisons with its neighbours (floating rounding can
    only move it by one), so the expression stays small inside codegen.
    """
    n = len(grid)
    x = _c(p)
    if n < 3:
        return reduce(add, [(x >= F.lit(float(g))).cast("int") for g in grid])
    step = (grid[-1] - grid[0]) / (n - 1)
    if max(abs((grid[i + 1] - grid[i]) - step) for i in range(n - 1)) > 1e-9 * max(1.0, abs(step)):
        return reduce(add, [(x >= F.lit(float(g))).cast("int") for g in grid])
    arr = F.array(*[F.lit(float(g)) for g in grid])
    c0 = F.least(F.greatest(F.floor((x - F.lit(grid[0])) / F.lit(step)) + 1, F.lit(0)), F.lit(n)).cast("int")
    # grid[c0] (0-based) is element c0 + 1 of the array
    up = F.when((c0 < n) & (F.element_at(arr, F.least(c0 + 1, F.lit(n))) <= x), c0 + 1).otherwise(c0)
    down = F.when((up > 0) & (F.element_at(arr, F.greatest(up, F.lit(1))) > x), up - 1).otherwise(up)
    return down.cast("int")
