"""A lens over windows with components: each method adds a projection; getters are actions (ME-*)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import align, arrays
from ..functions import electrical as E
from ..operators.detect import Detector, ZScore
from ..operators.timeseries import segments


@dataclass(frozen=True)
class Measurement:
    """df: one row with v (array) and i (components x samples), or p (components x samples)."""

    df: DataFrame
    fs: float
    t0: float = 0.0
    f0: float | None = None
    is_aligned: bool = False

    @staticmethod
    def from_vi(spark: SparkSession, v, i, fs: float, **kw) -> Measurement:
        i = [list(map(float, x)) for x in (i if hasattr(i[0], "__len__") else [i])]
        if any(len(x) != len(v) for x in i):
            raise ValueError("v and i differ in length")
        return Measurement(spark.createDataFrame([([float(x) for x in v], i)], "v array<double>, i array<array<double>>"), fs, **kw)

    @staticmethod
    def from_power(spark: SparkSession, p, fs: float, **kw) -> Measurement:
        p = [list(map(float, x)) for x in (p if hasattr(p[0], "__len__") else [p])]
        if len({len(x) for x in p}) != 1:
            raise ValueError("components differ in length")
        return Measurement(spark.createDataFrame([(p,)], "p array<array<double>>"), fs, **kw)

    @property
    def kind(self) -> str:
        return "vi" if "v" in self.df.columns else "power"

    def _components(self):
        return F.col("i" if self.kind == "vi" else "p")

    def _sum(self):
        c = self._components()
        return F.aggregate(F.slice(c, 2, F.size(c)), F.element_at(c, 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))

    def _one(self, column):
        return self.df.select(column).first()[0]

    @property
    def n_components(self) -> int:
        return self._one(F.size(self._components()))

    @property
    def n_samples(self) -> int:
        return self._one(F.size(F.element_at(self._components(), 1)))

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_components, self.n_samples

    @property
    def n_cycles(self) -> int:
        """Whole cycles; needs an aligned measurement."""
        return self.n_samples // self._one(F.col("cycle_size"))

    @property
    def duration(self) -> float:
        return self.n_samples / self.fs

    def vrms(self) -> float:
        return self._one(E.array_rms("v"))

    def irms(self) -> float:
        return self._one(E.array_rms(self._sum()))

    def active_power(self, per_component: bool = False):
        if self.kind == "power":
            return self._one(F.transform("p", E.mean)) if per_component else self._one(E.mean(self._sum()))
        return self._one(F.transform("i", lambda x: E.array_active_power(F.col("v"), x))) if per_component else self._one(E.array_active_power(F.col("v"), self._sum()))

    def apparent_power(self) -> float:
        return self.vrms() * self.irms()

    def reactive_power(self) -> float:
        return max(self.apparent_power() ** 2 - self.active_power() ** 2, 0.0) ** 0.5

    def power_factor(self) -> float:
        return self.active_power() / max(self.apparent_power(), 1e-12)

    def window(self, start: int, samples: int) -> Measurement:
        if self.is_aligned:
            raise ValueError("an aligned measurement has no sample clock")
        if samples < 1:
            raise ValueError("an empty window")
        cut = lambda x: F.slice(x, start + 1, samples)
        cols = [cut(F.col("v")).alias("v"), F.transform("i", cut).alias("i")] if self.kind == "vi" else [F.transform("p", cut).alias("p")]
        return replace(self, df=self.df.select(*cols), t0=self.t0 + start / self.fs)

    def seconds(self, start: float, duration: float) -> Measurement:
        return self.window(int(start * self.fs), int(duration * self.fs))

    def aligned(self, cycle_size: int = 64, n_cycles: int | None = None) -> Measurement:
        """Whole cycles of equal length, component by component."""
        one = self.df.select("v", F.posexplode("i").alias("c", "x")).select("c", align.cycle_align_udf(self.fs, cycle_size, n_cycles, self.f0)("v", "x").alias("a"))
        all_ = one.groupBy().agg(F.array_sort(F.collect_list(F.struct("c", "a"))).alias("s"))
        return replace(self, df=all_.select(F.flatten(F.element_at("s", 1)["a"]["v"]).alias("v"), F.transform("s", lambda x: F.flatten(x["a"]["i"])).alias("i"), F.lit(cycle_size).alias("cycle_size")), is_aligned=True)

    def lowpass(self, n: int) -> Measurement:
        if self.is_aligned:
            size = self._one(F.col("cycle_size"))
            cycles = lambda x: F.flatten(F.transform(arrays.patchify(x, size), lambda c: arrays.harmonic_lowpass(c, n)))
            return replace(self, df=self.df.withColumns({"v": cycles(F.col("v")), "i": F.transform("i", cycles)}))
        low = arrays.lowpass_udf(n)
        parts = self.df.select("v", F.posexplode("i").alias("c", "x")).select(low("v").alias("v"), "c", low("x").alias("x"))
        return replace(self, df=parts.groupBy().agg(F.first("v").alias("v"), F.array_sort(F.collect_list(F.struct("c", "x"))).alias("s")).select("v", F.transform("s", lambda x: x["x"]).alias("i")))

    def resample(self, size: int) -> Measurement:
        cols = {c: arrays.resample_linear(F.col(c), size) if c == "v" else F.transform(c, lambda x: arrays.resample_linear(x, size)) for c in self.df.columns if c in "vip"}
        return replace(self, df=self.df.withColumns(cols))

    def fryze(self):
        return self._one(E.fryze(F.col("v"), self._sum()))

    def vi_image(self, size: int = 32) -> DataFrame:
        return arrays.vi_raster(self.df.select(F.lit(0).alias("id"), "v", self._sum().alias("i")), ["id"], "v", "i", size)

    def spectrogram(self, window: int, hop: int):
        return self._one(arrays.spectrogram_udf(window, hop)(self._sum()))

    def harmonics(self, n: int = 6, normalize: bool = True) -> list[float]:
        """Mean magnitudes over cycles; needs an aligned measurement."""
        size = self._one(F.col("cycle_size"))
        rows = self.df.select(F.explode(arrays.patchify(self._sum(), size)).alias("c")).select(F.posexplode(arrays.harmonics("c", n, False)).alias("h", "m")).groupBy("h").agg(F.avg("m").alias("m")).orderBy("h").collect()
        m = [r["m"] for r in rows]
        return [x / max(m[1], 1e-12) for x in m] if normalize else m

    def _series(self) -> DataFrame:
        x = self._sum() if self.kind == "power" else F.zip_with("v", self._sum(), lambda a, b: a * b)
        return self.df.select(F.lit("m").alias("channel_id"), F.posexplode(x).alias("k", "x")).select("channel_id", F.col("k").cast("long").alias("k"), "x")

    def events(self, detector: Detector | None = None) -> list[int]:
        return sorted(r["k"] for r in (detector or ZScore()).apply(self._series()).collect())

    def segments(self, detector: Detector | None = None, min_length: int = 1) -> list[tuple[int, int]]:
        s = self._series()
        got = segments((detector or ZScore()).apply(s), s.groupBy("channel_id").agg(F.count("*").alias("n")), "channel_id", min_length)
        return sorted((r["start"], r["stop"]) for r in got.collect())

    def __add__(self, other: Measurement) -> Measurement:
        if self.kind != other.kind or self.fs != other.fs or self.n_samples != other.n_samples:
            raise ValueError("measurements of different kind, rate or length do not add")
        c = "i" if self.kind == "vi" else "p"
        return replace(self, df=self.df.crossJoin(other.df.select(F.col(c).alias("_o"))).withColumn(c, F.concat(c, "_o")).drop("_o"))  # one row each

    def __radd__(self, other):
        return self if other == 0 else NotImplemented

    def to_pandas(self):
        return self.df.toPandas()
