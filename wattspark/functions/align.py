"""Mains-cycle alignment (AL-*)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .electrical import col


def estimate_f0_udf(fs: float):
    """Arrow function: the frequency of the largest bin of the spectrum of v less its mean; the first of equal ones (AL-01)."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        def one(a):
            a = np.asarray(a, float)
            return float(np.argmax(np.abs(np.fft.rfft(a - a.mean()))) * fs / len(a))

        return v.map(one)

    return run


def rising_crossings(df: DataFrame, channel: str, value: str) -> DataFrame:
    """(channel, position): v[k] < 0 and v[k+1] >= 0, at k + v[k] / (v[k] - v[k+1]), the fraction in [0, 1] (AL-02)."""
    w = Window.partitionBy(channel).orderBy("k")
    after = df.withColumn("_n", F.lead(value).over(w)).where((F.col(value) < 0) & (F.col("_n") >= 0))
    part = F.greatest(F.least(F.col(value) / (F.col(value) - F.col("_n")), F.lit(1.0)), F.lit(0.0))
    return after.select(channel, (F.col("k") + part).alias("position"))


def array_crossings(v) -> Column:
    """The same over an array column."""
    v = col(v)
    pairs = F.transform(v, lambda x, k: F.struct(k.cast("double").alias("k"), x.cast("double").alias("a"), F.get(v, k + 1).cast("double").alias("b")))
    crossing = F.filter(pairs, lambda p: F.coalesce((p["a"] < 0) & (p["b"] >= 0), F.lit(False)))
    return F.transform(crossing, lambda p: p["k"] + F.greatest(F.least(p["a"] / (p["a"] - p["b"]), F.lit(1.0)), F.lit(0.0)))


def cycles_of(v: np.ndarray, fs: float, f0: float | None, tol: float) -> list[tuple[float, float]]:
    """Starts and ends of valid cycles: between neighbouring crossings, within tol of the expected length, which is fs/f0 or the lower median spacing."""
    k = np.flatnonzero((v[:-1] < 0) & (v[1:] >= 0))
    at = k + np.clip(v[k] / (v[k] - v[k + 1]), 0.0, 1.0)
    if len(at) < 2:
        return []
    length = np.diff(at)
    expected = fs / f0 if f0 else float(np.sort(length)[(len(length) - 1) // 2])
    ok = (np.abs(length - expected) <= tol * expected) & (length > 1)
    return [(float(a), float(b)) for a, b, good in zip(at, at[1:], ok) if good]


def sampled(x: np.ndarray, cycles: list[tuple[float, float]], size: int) -> np.ndarray:
    """Each cycle at `size` even points from its start, linearly between samples."""
    grid = np.array([a + (b - a) * np.arange(size) / size for a, b in cycles]).reshape(-1, size)
    return np.interp(grid, np.arange(len(x)), x)


def cycle_align_udf(fs: float, cycle_size: int, n_cycles: int | None = None, f0: float | None = None, tol: float = 0.2):
    """Arrow function of (v, i): struct(v, i: cycles x points; mask), the first n valid cycles, padded with zeros (AL-03)."""

    @F.pandas_udf("struct<v:array<array<double>>,i:array<array<double>>,mask:array<boolean>>")
    def run(v: pd.Series, i: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(v, i):
            a, b = np.asarray(a, float), np.asarray(b, float)
            found = cycles_of(a, fs, f0, tol)
            found = found[:n_cycles] if n_cycles else found
            pad = max(0, (n_cycles or 0) - len(found))
            zeros = [[0.0] * cycle_size] * pad
            out.append((sampled(a, found, cycle_size).tolist() + zeros, sampled(b, found, cycle_size).tolist() + zeros, [True] * len(found) + [False] * pad))
        return pd.DataFrame(out, columns=["v", "i", "mask"])

    return run


def samples_for_cycles(n_cycles: int, fs, f0, slack: float = 1.3) -> Column:
    """ceil((n + 1) * slack * fs / f0); an unknown f0 is 50 (WV-03)."""
    return F.ceil((n_cycles + 1) * slack * col(fs) / F.coalesce(F.nanvl(col(f0), F.lit(50.0)), F.lit(50.0))).cast("long")
