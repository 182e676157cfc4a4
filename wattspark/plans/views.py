"""Views: what turns raw windows into features, as column expressions (WV-03 to WV-09)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import align, arrays
from ..functions.electrical import array_active_power, mean
from .compat import supports


@dataclass
class HighFreqView:
    """Cycles of v and i: aligned to crossings, or cut every round(fs/f0) samples. The sampling rate is that of one call."""

    n_cycles: int = 10
    cycle_size: int = 128
    aligned: bool = True
    slack: float = 1.3

    def required_quantities(self, quantities=None) -> tuple[str, ...]:
        return ("v", "i")

    def supports(self) -> Column:
        return supports("aligned" if self.aligned else "raw")

    def window_samples(self) -> Column:
        return align.samples_for_cycles(self.n_cycles, "fs", "f0", self.slack)

    def output_shape(self) -> dict[str, tuple[int, ...]]:
        return {"v": (self.n_cycles, self.cycle_size), "i": (self.n_cycles, self.cycle_size), "cycle_mask": (self.n_cycles,)}

    def __call__(self, windows: DataFrame, fs: float, f0: float | None = None) -> DataFrame:
        """windows(v, i arrays) with cycles, cycle_mask and p_total, which is measured on what the cycles represent."""
        if fs / (f0 or 50.0) < 1.5:
            raise ValueError("fewer than two samples a cycle")
        if self.aligned:
            got = windows.withColumn("_a", align.cycle_align_udf(fs, self.cycle_size, self.n_cycles, f0)("v", "i"))
            got = got.withColumns({"v": F.col("_a.v"), "i": F.col("_a.i"), "cycle_mask": F.col("_a.mask")}).drop("_a")
            n = F.greatest(F.size(F.filter("cycle_mask", lambda m: m)), F.lit(1)) * self.cycle_size
            power = F.aggregate(F.zip_with("v", "i", lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)), F.lit(0.0), lambda s, x: s + x)
            return got.withColumn("p_total", power / n)
        period = round(fs / (f0 or 50.0))
        cycles = lambda x: F.transform(F.sequence(F.lit(0), F.lit(self.n_cycles - 1)), lambda j: arrays.resample_linear(F.slice(x, j * period + 1, F.lit(period)), self.cycle_size))
        got = windows.withColumns({"v": cycles(F.col("v")), "i": cycles(F.col("i")), "cycle_mask": F.array_repeat(F.lit(True), self.n_cycles)})
        return got.withColumn("p_total", array_active_power(F.flatten("v"), F.flatten("i")))


@dataclass
class LowFreqView:
    """n_steps block means at rate_hz, of active or apparent power."""

    rate_hz: float = 1.0
    n_steps: int = 60
    power: str = "active"

    def required_quantities(self, quantities=("v", "i", "p")) -> tuple[str, ...]:
        return ("v", "i") if {"v", "i"} <= set(quantities) else ("p",)

    def supports(self) -> Column:
        return supports("apparent" if self.power == "apparent" else "lowfreq", self.rate_hz)

    def window_samples(self) -> Column:
        return F.ceil(self.n_steps / self.rate_hz * F.col("fs")).cast("long")

    @property
    def window_seconds(self) -> float:
        return self.n_steps / self.rate_hz

    def output_shape(self) -> dict[str, tuple[int, ...]]:
        return {"p": (self.n_steps,)}

    def __call__(self, windows: DataFrame, fs: float | None = None) -> DataFrame:
        """windows with arrays v and i, or p: adds p (block means) and p_total (their mean)."""
        source = F.col("v") if "v" in windows.columns else F.col("p")
        block = F.greatest(F.floor(F.size(source) / self.n_steps), F.lit(1)).cast("int")
        n = F.least(F.floor(F.size(source) / block), F.lit(self.n_steps)).cast("int")
        part = lambda x, j: F.slice(x, j * block + 1, block)

        def value(j):
            if "v" not in windows.columns:
                return mean(part(F.col("p"), j))
            if self.power == "apparent":
                return F.sqrt(array_active_power(part(F.col("v"), j), part(F.col("v"), j))) * F.sqrt(array_active_power(part(F.col("i"), j), part(F.col("i"), j)))
            return array_active_power(part(F.col("v"), j), part(F.col("i"), j))

        out = windows.withColumn("p", F.transform(F.sequence(F.lit(0), n - 1), value))
        return out.withColumn("p_total", mean(F.col("p")))


VIEWS = {"aligned": lambda: HighFreqView(), "raw": lambda: HighFreqView(aligned=False), "lowfreq": lambda: LowFreqView()}


def window_samples(view, fs: float, f0: float | None = None) -> int:
    """window_samples for one rate, on the driver."""
    if isinstance(view, HighFreqView):
        return math.ceil((view.n_cycles + 1) * view.slack * fs / (f0 or 50.0))
    return math.ceil(view.n_steps / view.rate_hz * fs)


def raw_windows(index: DataFrame, signals: DataFrame, quantities: tuple[str, ...]) -> DataFrame:
    """index(channel_id, start, length) with an array a quantity: only chunks that a window touches are joined; zeros past the end (SRC-18, WV-10)."""
    from ..schemas import CHUNK

    touched = index.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / CHUNK), F.floor((F.col("start") + F.col("length") - 1) / CHUNK))))
    out = index
    for q in quantities:
        near = touched.join(signals.where(F.col("quantity") == q).select("channel_id", "chunk", F.col("start").alias("_s"), "values"), ["channel_id", "chunk"])
        lo = F.greatest(F.col("start") - F.col("_s"), F.lit(0))
        part = F.slice("values", (lo + 1).cast("int"), F.greatest(F.least(F.col("start") + F.col("length") - F.col("_s"), F.size("values").cast("long")) - lo, F.lit(0)).cast("int"))
        whole = near.groupBy("channel_id", "start", "length").agg(F.array_sort(F.collect_list(F.struct("_s", part.alias("x")))).alias("_p"))
        flat = F.flatten(F.transform("_p", lambda p: p["x"]))
        padded = whole.select("channel_id", "start", "length", F.transform(F.concat(flat, F.array_repeat(F.lit(0.0).cast("float"), (F.col("length") - F.size(flat)).cast("int"))), lambda x: x.cast("double")).alias(q))
        out = out.join(padded, ["channel_id", "start", "length"], "left")
    return out


def register(name: str, make) -> None:
    """Adds a view of one's own: make() gives an object with supports(), window_samples(), output_shape() and a call on windows (WV-08)."""
    missing = [m for m in ("supports", "window_samples", "output_shape", "__call__") if not hasattr(make(), m)]
    if missing:
        raise TypeError(f"a view needs {missing}")
    VIEWS[name] = make


def collate(items: list[dict]) -> dict:
    """One batch of window items: arrays and numbers are stacked, all else stays a list (WV-12). Items whose keys differ are refused (SO-05)."""
    import numpy as np

    odd = set().union(*items) - set.intersection(*map(set, items)) if items else set()
    if odd:
        raise ValueError(f"items of a batch must have the same keys; only some have {sorted(odd)}")
    stack = lambda x: np.stack([np.asarray(y) for y in x]) if isinstance(x[0], (int, float, list, np.ndarray, np.generic)) else x
    return {k: stack([item[k] for item in items]) for k in (items[0] if items else [])}


def batches(windows: DataFrame, size: int):
    """Collated batches of a DataFrame of windows, fetched a partition at a time (WV-10)."""
    held: list[dict] = []
    for row in windows.toLocalIterator():
        held.append(row.asDict())
        if len(held) == size:
            yield collate(held)
            held = []
    if held:
        yield collate(held)
