"""The window index (WV-01, WV-02, PF-08, SL-03, AG-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_index(channels: DataFrame, width: Column, stride: float = 1.0, drop_last: bool = True, max_per_channel: int | None = None, order: list[str] | None = None) -> DataFrame:
    """(channel_id, window_idx, start, length) for channels(channel_id, n_samples, ...).

    hop = max(1, half-even round of width * stride); starts 0, hop, ... up to n - width, or to n - 1 without drop_last; shorter channels have none.
    A cap keeps evenly spaced starts, half-even rounded.
    """
    if not 0 < stride <= 1:
        raise ValueError("stride must lie in (0, 1]")
    w = width.cast("long")
    base = channels.withColumn("length", w).withColumn("_hop", F.greatest(F.bround(F.col("length") * stride).cast("long"), F.lit(1)))
    last = F.col("n_samples") - F.col("length") if drop_last else F.col("n_samples") - 1
    base = base.withColumn("_last", last).where((F.col("_last") >= 0) & (F.col("n_samples") >= F.col("length")))
    n = F.floor(F.col("_last") / F.col("_hop")) + 1
    every = F.sequence(F.lit(0).cast("long"), n - 1)
    if max_per_channel is not None:
        m = max_per_channel
        even = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.bround(i * (n - 1) / max(m - 1, 1)).cast("long")))
        every = F.when(n > m, even).otherwise(every)
    rows = base.select("channel_id", "length", F.explode(every).alias("_i"), "_hop").select("channel_id", (F.col("_i") * F.col("_hop")).alias("start"), "length")
    return rows


def numbered(index: DataFrame) -> DataFrame:
    """Adds window_idx in the order of channel_id and start: places within channels, plus the windows of the channels before.

    The running sum goes over one row a channel."""
    within = index.withColumn("_k", F.row_number().over(Window.partitionBy("channel_id").orderBy("start")) - 1)
    counts = index.groupBy("channel_id").count()
    before = counts.withColumn("_b", F.coalesce(F.sum("count").over(Window.orderBy("channel_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return within.join(before, "channel_id").withColumn("window_idx", (F.col("_k") + F.col("_b")).cast("long")).drop("_k", "_b")


def window_counts(index: DataFrame, channels: DataFrame) -> DataFrame:
    """Windows a channel, zeros kept."""
    return channels.select("channel_id").join(index.groupBy("channel_id").agg(F.count("*").alias("n_windows")), "channel_id", "left").fillna(0, ["n_windows"])


def subset(index: DataFrame, keep: DataFrame) -> DataFrame:
    return index.join(keep.select("window_idx"), "window_idx", "left_semi")


def block_means(series: DataFrame, keys: list[str], n_steps: int, value: Column, length: str = "length", offset: str = "offset") -> DataFrame:
    """Low-rate view of long windows: block = max(1, length div n_steps) samples to a mean, the rest cut off (WV-07)."""
    block = F.greatest(F.floor(F.col(length) / n_steps), F.lit(1))
    return series.withColumn("step", F.floor(F.col(offset) / block)).where(F.col("step") < n_steps).groupBy(*keys, "step").agg(value.alias("p"))
