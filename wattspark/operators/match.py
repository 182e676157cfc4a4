"""Matching predicted with true events, and event metrics (JN-07, MT-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_events(predicted: DataFrame, actual: DataFrame, channel: str, tolerance: int = 8) -> DataFrame:
    """(channel, predicted, actual): nearest pairs first, each event once; ties by predicted, then actual position.

    Candidates come from an equi-join on time buckets of the tolerance's width, so they are as many as events lie close together.
    """
    width = max(tolerance, 1)
    p = predicted.select(channel, F.col("k").alias("p"), F.explode(F.array(*(F.floor(F.col("k") / width) + d for d in (-1, 0, 1)))).alias("_b"))
    a = actual.select(channel, F.col("k").alias("a"), F.floor(F.col("k") / width).alias("_b"))
    near = p.join(a, [channel, "_b"]).where(F.abs(F.col("p") - F.col("a")) <= tolerance)
    kind = "array<struct<p:bigint,a:bigint>>"

    def step(acc, x):
        free = ~F.exists(acc, lambda y: (y["p"] == x["p"]) | (y["a"] == x["a"]))
        return F.when(free, F.concat(acc, F.array(F.struct(x["p"].alias("p"), x["a"].alias("a"))))).otherwise(acc)

    pairs = F.array_sort(F.collect_list(F.struct(F.abs(F.col("p") - F.col("a")).alias("d"), "p", "a")))
    # Pairs further apart than the tolerance never touch, so each cluster of close events is folded by itself.
    from pyspark.sql import Window

    order = Window.partitionBy(channel).orderBy(F.least("p", "a"), F.greatest("p", "a"))
    reach = F.max(F.greatest("p", "a")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    clustered = near.withColumn("_new", (F.least("p", "a") > F.coalesce(reach, F.lit(-1))).cast("int")).withColumn("_c", F.sum("_new").over(order))
    return clustered.groupBy(channel, "_c").agg(F.aggregate(pairs, F.array().cast(kind), step).alias("m")).select(channel, F.explode("m").alias("m")).select(channel, F.col("m.p").alias("predicted"), F.col("m.a").alias("actual"))


def event_counts(predicted: DataFrame, actual: DataFrame, channel: str, tolerance: int = 8, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and mean timing error, over all channels or by columns of both inputs."""
    by = by or []
    m = match_events(predicted, actual, channel, tolerance)
    if by:
        m = m.join(predicted.select(channel, *by).distinct(), channel)
    tp = m.groupBy(*by).agg(F.count("*").alias("tp"), F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("timing"))
    n_p, n_a = predicted.groupBy(*by).agg(F.count("*").alias("n_p")), actual.groupBy(*by).agg(F.count("*").alias("n_a"))
    if by:
        out = n_p.join(n_a, by, "full").join(tp, by, "left")
    else:
        out = n_p.crossJoin(n_a).crossJoin(tp)  # one row each
    c = lambda x: F.coalesce(F.col(x), F.lit(0))
    out = out.select(*by, c("tp").alias("tp"), (c("n_p") - c("tp")).alias("fp"), (c("n_a") - c("tp")).alias("fn"), "timing")
    eps = 1e-9
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp") + eps), F.col("tp") / (F.col("tp") + F.col("fn") + eps)
    return out.withColumns({"precision": precision, "recall": recall, "f1": 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn") + eps)})
