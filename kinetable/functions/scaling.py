"""Scaling of vectors by statistics, and binning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.functions.names import named

EPS = 1e-8
# The statistics each mode scales by.
MODES = {
    "MEAN_STD": ("mean", "std"), "MIN_MAX": ("min", "max"),
    "QUANTILES": ("q01", "q99"), "QUANTILE10": ("q10", "q90"), "IDENTITY": (),
}


def stats_row(stats: DataFrame, vectors: dict[str, list[tuple[str, int]]]) -> DataFrame:
    """Statistics rows as one row of vectors ``<vector>__<stat>``, entries in the given order."""
    names = [c for c in stats.columns if c not in ("feature", "dim", "count")]
    picks = []
    for vector, entries in vectors.items():
        for n in names:
            values = [F.max(F.when((F.col("feature") == f) & (F.col("dim") == d), F.col(n))) for f, d in entries]
            picks.append(F.array(*values).alias(f"{vector}__{n}"))
    return stats.agg(*picks)


def _pair(key: str, mode: str, columns: list[str]) -> tuple[Column, Column]:
    names = [f"{key}__{s}" for s in MODES[mode]]
    missing = [n for n in names if n not in columns]
    if missing:
        raise ValueError(f"mode {mode} of {key!r} needs the statistics {MODES[mode]}")
    return named(names[0]), named(names[1])


def _each(vector: Column, a: Column, b: Column, fn) -> Column:
    return F.transform(F.arrays_zip(vector.alias("x"), a.alias("a"), b.alias("b")), lambda s: fn(s["x"], s["a"], s["b"]))


def _scaled_keys(frames: DataFrame, stats: DataFrame, modes: dict[str, str]):
    for key, mode in modes.items():
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        known = any(c.startswith(f"{key}__") for c in stats.columns)
        if key in frames.columns and mode != "IDENTITY" and known:
            yield key, mode


def normalize(frames: DataFrame, stats: DataFrame, modes: dict[str, str], *, eps: float = EPS, clipped: bool = False) -> DataFrame:
    """Scale vector columns by mode with a one-row ``stats_row``; a feature without statistics passes through.

    ``clipped`` is the training-data variant: the divisor is at least ``eps`` and quantile
    modes clip to their range first.
    """
    out = frames.crossJoin(stats)  # one row
    for key, mode in _scaled_keys(frames, stats, modes):
        low, high = _pair(key, mode, stats.columns)
        if mode == "MEAN_STD":
            fn = (lambda x, m, s: (x - m) / F.greatest(s, F.lit(eps))) if clipped else (lambda x, m, s: (x - m) / (s + eps))
        elif clipped and mode == "MIN_MAX":
            fn = lambda x, a, b: (x - a) * 2 / F.greatest(b - a, F.lit(eps)) - 1
        elif clipped:
            fn = lambda x, a, b: (F.least(F.greatest(x, a), b) - a) * 2 / F.greatest(b - a, F.lit(eps)) - 1
        else:
            fn = lambda x, a, b: (x - a) * 2 / F.when(a == b, F.lit(eps)).otherwise(b - a) - 1
        out = out.withColumn(key, _each(named(key), low, high, fn))
    return out.drop(*stats.columns)


def unnormalize(frames: DataFrame, stats: DataFrame, modes: dict[str, str], *, eps: float = EPS) -> DataFrame:
    """Inverse of ``normalize``; the mean-std inverse multiplies by the plain std."""
    out = frames.crossJoin(stats)  # one row
    for key, mode in _scaled_keys(frames, stats, modes):
        low, high = _pair(key, mode, stats.columns)
        if mode == "MEAN_STD":
            fn = lambda x, m, s: x * s + m
        else:
            fn = lambda x, a, b: (x + 1) / 2 * F.when(a == b, F.lit(eps)).otherwise(b - a) + a
        out = out.withColumn(key, _each(named(key), low, high, fn))
    return out.drop(*stats.columns)


def fit_bounds(values: Column, size: Column, default: float) -> Column:
    """Bounds cut or padded to the size of the vector they scale."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.get(values, i), F.lit(default)))


def minmax_zero_safe(vector: Column, low: Column, high: Column) -> Column:
    """To [-1, 1]; a dimension without range maps to 0. Short bounds are padded with 0 and 1."""
    size = F.size(vector)
    return _each(vector, fit_bounds(low, size, 0.0), fit_bounds(high, size, 1.0),
                 lambda x, a, b: F.when(a == b, 0.0).otherwise((x - a) * 2 / (b - a) - 1))


def minmax_zero_safe_inverse(vector: Column, low: Column, high: Column) -> Column:
    """Back from [-1, 1]; a dimension without range gives its bound. Short bounds are padded with 0."""
    size = F.size(vector)
    return _each(vector, fit_bounds(low, size, 0.0), fit_bounds(high, size, 0.0),
                 lambda x, a, b: F.when(a == b, a).otherwise((x + 1.0) * 0.5 * (b - a) + a))


def discretize(vector: Column, bins: int = 256) -> Column:
    """Bin of each value over [-1, 1): -1 below, the last bin above."""
    return F.transform(vector, lambda x: F.least(F.lit(bins - 1), F.greatest(F.lit(-1), F.floor((x + 1) * (bins / 2)))).cast("int"))
