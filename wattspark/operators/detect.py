"""Event detectors over long series (channel, k, x). Each gives the rows (channel, k) of its events.

Scores are decided with a relative slack of 1e-12 above the threshold, so that rounding never makes an event of a score that equals it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import timeseries as T

EPS = 1e-6


def over(score: Column, threshold: float) -> Column:
    return score > threshold + abs(threshold) * 1e-12


class Detector:
    """apply(df, channel, value): rows (channel, k). Any object with this method can stand where a detector is asked for."""

    min_gap = 1

    def scored(self, df: DataFrame, channel: str, value: str, block: int | None = None) -> DataFrame:
        raise NotImplementedError

    def apply(self, df: DataFrame, channel: str = "channel_id", value: str = "x", block: int | None = None) -> DataFrame:
        return T.suppressed(self.scored(df, channel, value, block).where("fired").select(channel, "k"), channel, self.min_gap)


@dataclass
class ZScore(Detector):
    """Distance from the causal mean, in causal deviations (TS-05)."""

    window: int = 32
    threshold: float = 4.0
    min_gap: int = 8
    min_delta: float = 0.0

    def scored(self, df, channel, value, block=None):
        s = T.frame_stats(df, channel, value, {"c": (-(self.window - 1), 0)}, block)
        far = F.abs(F.col(value) - F.col("c_mean"))
        return s.withColumn("fired", over(far / F.greatest(F.sqrt("c_var"), F.lit(EPS)), self.threshold) & (far > self.min_delta))


@dataclass
class Cusum(Detector):
    """Two accumulators of the drift from the causal mean; both restart where one fires (TS-06).

    Each channel is read from front to back in batches; the state is the two accumulators.
    """

    window: int = 64
    threshold: float = 50.0
    drift: float = 1.0

    def apply(self, df, channel="channel_id", value="x", block=None):
        s = T.frame_stats(df, channel, value, {"c": (-(self.window - 1), 0)}, block).withColumn("_d", F.col(value) - F.col("c_mean"))
        drift, limit = self.drift, self.threshold + abs(self.threshold) * 1e-12

        def step(state, k, x):
            (up, down), kept = state, []
            for i, d in enumerate(x.tolist()):
                up, down = max(up + d - drift, 0.0), max(down - d - drift, 0.0)
                if up > limit or down > limit:
                    up = down = 0.0
                    kept.append(i)
            return kept, (up, down)

        return T.scanned(s, channel, "_d", lambda: (0.0, 0.0), step)


class _TwoSided(Detector):
    pre = post = 32
    min_delta = 0.0

    def sides(self, df, channel, value, block):
        s = T.frame_stats(df, channel, value, {"l": (-self.pre, -1), "r": (1, self.post)}, block)
        return s.withColumn("_delta", F.col("r_mean") - F.col("l_mean"))


@dataclass
class Glr(_TwoSided):
    """Generalised likelihood ratio of one level against two (TS-07)."""

    pre: int = 32
    post: int = 32
    threshold: float = 100.0
    min_gap: int = 8
    min_delta: float = 0.0

    def scored(self, df, channel, value, block=None):
        s, n, m = self.sides(df, channel, value, block), self.pre, self.post
        pooled = (n * F.col("l_var") + m * F.col("r_var")) / (n + m)
        score = (n * m / (n + m)) * F.col("_delta") * F.col("_delta") / F.greatest(pooled, F.lit(EPS))
        return s.withColumn("fired", over(score, self.threshold) & (F.abs("_delta") > self.min_delta))


@dataclass
class GoodnessOfFit(_TwoSided):
    """Misfit of what follows to what went before (TS-08)."""

    pre: int = 32
    post: int = 32
    threshold: float = 200.0
    min_gap: int = 8
    min_delta: float = 0.0

    def scored(self, df, channel, value, block=None):
        s = self.sides(df, channel, value, block)
        score = self.post * (F.col("_delta") * F.col("_delta") + F.col("r_var")) / F.greatest("l_var", F.lit(EPS))
        return s.withColumn("fired", over(score, self.threshold) & (F.abs("_delta") > self.min_delta))


@dataclass
class AdaptiveThreshold(_TwoSided):
    """A step over base watts plus scale deviations of what went before (TS-09)."""

    window: int = 32
    base: float = 20.0
    scale: float = 4.0
    min_gap: int = 8

    def __post_init__(self):
        self.pre = self.post = self.window

    def scored(self, df, channel, value, block=None):
        s = self.sides(df, channel, value, block)
        limit = self.base + self.scale * F.sqrt(F.greatest("l_var", F.lit(EPS)))
        return s.withColumn("fired", F.abs("_delta") > limit * (1 + 1e-12))


@dataclass
class Multivariate(Detector):
    """One detector on several quantities, each fired mask widened by align, combined by any, all or vote (TS-10)."""

    detector: Detector
    rule: str = "any"
    align: int = 4

    def apply_many(self, df: DataFrame, values: list[str], channel: str = "channel_id") -> DataFrame:
        if self.rule not in ("any", "all", "vote"):
            raise ValueError(f"unknown rule {self.rule!r}")
        base = df.select(channel, "k")
        parts = []
        for v in values:
            hit = self.detector.apply(df, channel, v).withColumn("fired", F.lit(True))
            mask = base.join(hit, [channel, "k"], "left").withColumn("fired", F.coalesce("fired", F.lit(False)))
            parts.append(T.dilate(mask, [channel], "fired", self.align))
        votes = reduce(DataFrame.unionByName, parts).groupBy(channel, "k").agg(F.sum(F.col("fired").cast("int")).alias("votes"))
        n = len(values)
        fired = {"any": F.col("votes") > 0, "all": F.col("votes") == n, "vote": 2 * F.col("votes") > n}[self.rule]
        edges = T.leading_edge(votes.withColumn("fired", fired), channel, "fired").where("edge").select(channel, "k")
        return T.suppressed(edges, channel, 2 * self.align + 1)


@dataclass
class ActiveSections(Detector):
    """Spans whose causal deviation exceeds the threshold, short runs closed (TS-13)."""

    window: int = 16
    threshold: float = 20.0
    min_steady: int = 8

    def mask(self, df, channel="channel_id", value="x", block=None):
        s = T.frame_stats(df, channel, value, {"c": (-(self.window - 1), 0)}, block)
        return s.withColumn("active", over(F.sqrt("c_var"), self.threshold))

    def sections(self, df, channel="channel_id", value="x", block=None):
        closed = T.close_short_runs(T.islands(self.mask(df, channel, value, block), channel, "active"), channel, "active", self.min_steady)
        # Runs that closing has made equal join into one.
        w = T.Window.partitionBy(channel).orderBy("start")
        joined = closed.withColumn("_c", F.coalesce((F.col("active") != F.lag("active").over(w)).cast("int"), F.lit(0))).withColumn("_g", F.sum("_c").over(w))
        return joined.groupBy(channel, "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("active").alias("active")).where("active").select(channel, "start", "stop")

    def apply(self, df, channel="channel_id", value="x", block=None):
        return self.sections(df, channel, value, block).select(channel, F.col("start").alias("k"))


DETECTORS = {"zscore": ZScore, "cusum": Cusum, "glr": Glr, "gof": GoodnessOfFit, "adaptive": AdaptiveThreshold, "active": ActiveSections}
