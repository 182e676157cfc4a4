"""Representations: array columns to array columns (RP-*).

Short arrays (a mains cycle of up to about 128 points) stay in the JVM with higher-order functions; `fft_udf` and `spectrogram_udf` are Arrow
functions for long ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .electrical import col, let, mean, total


def adaptive_mean(x, size: int) -> Column:
    """PAA and Downsample: bin j is the mean of [floor(j*T/s), ceil((j+1)*T/s)) (RP-08)."""
    x = col(x)
    n = F.size(x)

    def bin_(j):
        a = F.floor(j * n / size).cast("int")
        b = F.ceil((j + 1) * n / size).cast("int")
        return mean(F.transform(F.slice(x, a + 1, b - a), lambda y: y.cast("double")))

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), bin_)


def patchify(x, patch: int, stride: int | None = None) -> Column:
    """Windows of patch points every stride points; the rest at the end is dropped (RP-09)."""
    x, stride = col(x), stride or patch
    n = F.floor((F.size(x) - patch) / stride).cast("int")
    return F.when(F.size(x) >= patch, F.transform(F.sequence(F.lit(0), n), lambda j: F.slice(x, j * stride + 1, F.lit(patch)))).otherwise(F.filter(F.array(x), lambda _: F.lit(False)))


def standard_scale(x, mean_: float, std: float) -> Column:
    return F.transform(col(x), lambda y: (y.cast("double") - mean_) / max(std, 1e-12))


def resample_linear(x, size: int) -> Column:
    """Linear, half-pixel centres: source = (j + 0.5) * T / size - 0.5, clamped (RP-12)."""
    x = col(x)
    n = F.size(x)

    def at(j):
        s = F.least(F.greatest((j + 0.5) * n / size - 0.5, F.lit(0.0)), (n - 1).cast("double"))
        a = F.floor(s).cast("int")
        b = F.least(a + 1, n - 1)
        left, right = F.get(x, a).cast("double"), F.get(x, b).cast("double")
        return left + (right - left) * (s - a)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)


def distance_matrix(x) -> Column:
    """|x_i - x_j| (RP-07)."""
    x = col(x)
    return F.transform(x, lambda a: F.transform(x, lambda b: F.abs(a.cast("double") - b.cast("double"))))


def dft(x, bins: int) -> Column:
    """array<struct(re, im)>: the first bins of the real DFT, unscaled."""
    x = col(x)
    n = F.size(x)

    def one(h):
        turn = lambda k: -2 * math.pi * h * k / n
        return F.struct(total(F.transform(x, lambda y, k: y.cast("double") * F.cos(turn(k)))).alias("re"), total(F.transform(x, lambda y, k: y.cast("double") * F.sin(turn(k)))).alias("im"))

    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), one)


def re_im(x, n: int) -> Column:
    """The first n bins divided by the length, all real parts and then all imaginary ones; bins that the length lacks are 0 (RP-03)."""
    x = col(x)
    have = F.floor(F.size(x) / 2) + 1
    z = dft(x, n)
    part = lambda name: F.transform(z, lambda c, h: F.when(h < have, c[name] / F.size(x)).otherwise(0.0))
    return F.concat(part("re"), part("im"))


def harmonic_lowpass(x, n: int) -> Column:
    """The signal of the first n bins of its real DFT; the mean counts as one (RP-02).

    The bins are computed once a row, and so is x: where the result is exploded, Spark also filters by its size below joins, with x written out.
    """

    def signal(x, z):
        size = F.size(x)

        def at(k):
            def term(c, h):
                turn = 2 * math.pi * h * k / size
                once = (h == 0) | (2 * h == size)
                return F.when(2 * h <= size, F.when(once, 1.0).otherwise(2.0) * (c["re"] * F.cos(turn) - c["im"] * F.sin(turn))).otherwise(0.0)

            return total(F.transform(z, term)) / size

        return F.transform(x, lambda _, k: at(k))

    return let(col(x), lambda a: let(dft(a, n), lambda z: signal(a, z)))


def harmonics(x, n: int, normalize: bool = True) -> Column:
    """Magnitudes of the first n bins, over that of bin 1 if normalize (RP-11, one cycle)."""
    m = F.transform(dft(x, n), lambda c: F.sqrt(c["re"] * c["re"] + c["im"] * c["im"]))
    return let(m, lambda a: F.transform(a, lambda y: y / F.greatest(F.get(a, F.lit(1)), F.lit(1e-12)))) if normalize else m


def dfia(v, i, size: int) -> Column:
    """The size x size corner of the 2-D DFT of the outer product over N*N: struct(magnitude, angle). Separable (RP-05)."""
    v, i = col(v), col(i)
    a, b = dft(v, size), dft(i, size)
    n2 = F.size(v) * F.size(i)
    cell = lambda p, q: F.struct(((p["re"] * q["re"] - p["im"] * q["im"]) / n2).alias("re"), ((p["re"] * q["im"] + p["im"] * q["re"]) / n2).alias("im"))
    z = F.transform(a, lambda p: F.transform(b, lambda q: cell(p, q)))
    return F.transform(z, lambda row: F.transform(row, lambda c: F.struct(F.sqrt(c["re"] * c["re"] + c["im"] * c["im"]).alias("magnitude"), F.atan2(c["im"], c["re"]).alias("angle"))))


def vi_cells(v, i, size: int, normalize: bool = True) -> Column:
    """array<struct(row, col, slope, power)>: the raster cell of each sample; half-even rounding (RP-06)."""
    v, i = col(v), col(i)
    peak = lambda x: F.greatest(F.array_max(F.transform(x, lambda y: F.abs(y.cast("double")))), F.lit(1e-12)) if normalize else F.lit(1.0)
    cell = lambda y, p: F.least(F.greatest(F.bround((y / p + 1.0) / 2.0 * (size - 1)), F.lit(0.0)), F.lit(size - 1.0)).cast("int")

    def one(x, k, pv, pi):
        a, b = x.cast("double"), F.get(i, k).cast("double")
        dv, di = F.coalesce(F.get(v, k + 1).cast("double") - a, F.lit(0.0)), F.coalesce(F.get(i, k + 1).cast("double") - b, F.lit(0.0))
        return F.struct(cell(b, pi).alias("row"), cell(a, pv).alias("col"), (F.atan2(di / pi, dv / pv) / math.pi).alias("slope"), F.abs(a / pv * b / pi).alias("power"))

    return let(peak(v), lambda pv: let(peak(i), lambda pi: F.transform(v, lambda x, k: one(x, k, pv, pi))))


def vi_raster(df, keys: list[str], v: str, i: str, size: int, normalize: bool = True):
    """Long form of the three channels: (keys, row, col, occupancy, slope, power); empty cells have no row."""
    cells = df.select(*keys, F.explode(vi_cells(v, i, size, normalize)).alias("c")).select(*keys, "c.*")
    return cells.groupBy(*keys, "row", "col").agg(F.lit(1).alias("occupancy"), F.max("slope").alias("slope"), F.max("power").alias("power"))


def spectrogram_udf(window: int, hop: int, n_fft: int | None = None, eps: float = 1e-10):
    """Arrow function: magnitudes in dB, 10*log10(max(|X|, eps)), periodic Hann window, reflected edges, normalised (RP-04)."""
    n_fft = n_fft or window

    @F.pandas_udf("array<array<double>>")
    def run(x: pd.Series) -> pd.Series:
        w = np.hanning(window + 1)[:-1]
        lead = (n_fft - window) // 2
        w = np.pad(w, (lead, n_fft - window - lead))
        scale = np.sqrt((w**2).sum())

        def one(a):
            a = np.pad(np.asarray(a, float), n_fft // 2, mode="reflect")
            frames = np.lib.stride_tricks.sliding_window_view(a, n_fft)[::hop] * w
            return (10 * np.log10(np.maximum(np.abs(np.fft.rfft(frames, axis=1)) / scale, eps))).T.tolist()

        return x.map(one)

    return run


def lowpass_udf(n: int):
    """Arrow function of harmonic_lowpass for long arrays."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        def one(a):
            z = np.fft.rfft(np.asarray(a, float))
            z[n:] = 0
            return np.fft.irfft(z, len(a))

        return x.map(one)

    return run


def cycle_input(v, i, mode: str = "vi") -> Column:
    """Channels of a cycle: v and i, i alone, or the Fryze parts (RP-13)."""
    from .electrical import fryze

    v, i = col(v), col(i)
    if mode == "vi":
        return F.array(v, i)
    if mode == "i":
        return F.array(i)
    if mode == "fryze":
        f = fryze(v, i)
        return F.array(f["v"], f["active"], f["residual"])
    raise ValueError(f"unknown input {mode!r}")


def sequence_input(x, normalize: str | None = None) -> Column:
    """A sequence over its peak or its mean magnitude."""
    x = col(x)
    if normalize is None:
        return x
    size = F.transform(x, lambda y: F.abs(y.cast("double")))
    by = {"peak": F.array_max(size), "mean": mean(size)}[normalize]
    return let(by, lambda b: F.transform(x, lambda y: y / F.greatest(b, F.lit(1e-12))))
