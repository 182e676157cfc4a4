"""Metric aggregates over long rows (window, appliance, ...), each one partial and final aggregation (MT-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9

from . import match


def truth(x: Column | str) -> Column:
    """Numbers over 0.5 are true."""
    return (F.col(x) if isinstance(x, str) else x).cast("double") > 0.5


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def confusion(df: DataFrame, predicted: str, actual: str, by: list[str]) -> DataFrame:
    p, a = truth(predicted), truth(actual)
    return df.groupBy(*by).agg(count_if(p & a).alias("tp"), count_if(p & ~a).alias("fp"), count_if(~p & a).alias("fn"), count_if(~p & ~a).alias("tn"))


def f1(tp="tp", fp="fp", fn="fn") -> Column:
    return 2 * F.col(tp) / (2 * F.col(tp) + F.col(fp) + F.col(fn) + EPS)


def detection_f1(df: DataFrame, predicted: str, actual: str, appliance: str) -> DataFrame:
    """macro (over appliances that occur) and micro F1 (MT-01)."""
    each = confusion(df, predicted, actual, [appliance])
    return each.agg(F.avg(F.when(F.col("tp") + F.col("fn") > 0, f1())).alias("f1_macro"), (2 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn") + EPS)).alias("f1_micro"))


def matthews(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """MT-02"""
    c = confusion(df, predicted, actual, [])
    d = lambda x: F.col(x).cast("double")
    den = F.sqrt((d("tp") + d("fp")) * (d("tp") + d("fn")) * (d("tn") + d("fp")) * (d("tn") + d("fn")))
    return c.select(((d("tp") * d("tn") - d("fp") * d("fn")) / F.greatest(den, F.lit(EPS))).alias("mcc"))


def power_metrics(df: DataFrame, predicted: str, actual: str, appliance: str, window: str, mask: str | None = None) -> DataFrame:
    """mae, nde, sae and teca in two levels of aggregation (MT-03 to MT-06). The mask does not hold for teca."""
    e, y = F.abs(F.col(predicted) - F.col(actual)), F.col(actual)
    m = F.col(mask) if mask else F.lit(True)
    rows = df.select(appliance, window, e.alias("e"), y.alias("y"), F.col(predicted).alias("p"), m.alias("m"))
    flat = rows.agg((F.sum(F.when(F.col("m"), F.col("e"))) / F.greatest(count_if(F.col("m")), F.lit(1))).alias("mae"), (F.sum(F.when(F.col("m"), F.col("e"))) / F.greatest(F.sum(F.when(F.col("m"), F.abs("y"))), F.lit(EPS))).alias("nde"))
    each = rows.where("m").groupBy(appliance).agg(F.sum("p").alias("sp"), F.sum("y").alias("sy"))
    sae = each.agg(F.avg(F.when(F.abs("sy") > EPS, F.abs(F.col("sp") - F.col("sy")) / F.abs("sy"))).alias("sae"))
    per = rows.groupBy(window).agg(F.sum("e").alias("e"), F.sum("y").alias("y"))
    teca = per.agg(F.avg(F.when(F.col("y") > EPS, 1 - F.col("e") / (2 * F.col("y")))).alias("teca"))
    return flat.crossJoin(sae).crossJoin(teca)  # one row each


def joint_metrics(df: DataFrame, predicted: str, actual: str, on_predicted: str, on_actual: str, delta_f1: float = 0.2, delta_jaccard: float = 20.0) -> DataFrame:
    """modified_f1 (relative tolerance) and modified_jaccard (watts) (MT-07, MT-08)."""
    p, a = truth(on_predicted), truth(on_actual)
    e = F.abs(F.col(predicted) - F.col(actual))
    near_f, near_j = e <= delta_f1 * F.abs(F.col(actual)), e <= delta_jaccard
    c = df.agg(count_if(p & a & near_f).alias("af"), count_if(p & a & ~near_f).alias("if"), count_if(p & a & near_j).alias("aj"), count_if(p & a & ~near_j).alias("ij"), count_if(p & ~a).alias("fp"), count_if(~p & a).alias("fn"))
    x = F.col
    return c.select((x("af") / (x("af") + x("if") + 0.5 * (x("fp") + x("fn")) + EPS)).alias("modified_f1"), (x("aj") / (x("aj") + x("ij") + x("fp") + x("fn") + EPS)).alias("modified_jaccard"))


def calibration_error(df: DataFrame, probability: str, actual: str, bins: int = 15) -> DataFrame:
    """Sum over bins of |sum of confidence - number right| over N; the confidence is that of the predicted class (MT-09)."""
    p = F.col(probability)
    said = p > 0.5
    conf = F.when(said, p).otherwise(1 - p)
    b = F.least(F.floor(conf * bins), F.lit(bins - 1))
    each = df.select(conf.alias("c"), (said == truth(actual)).cast("double").alias("r"), b.alias("b")).groupBy("b").agg(F.sum("c").alias("c"), F.sum("r").alias("r"), F.count("*").alias("n"))
    return each.agg((F.sum(F.abs(F.col("c") - F.col("r"))) / F.sum("n")).alias("ece"))


def unknown_auroc(df: DataFrame, score: str, actual: str, tie: str) -> DataFrame:
    """Rank statistic; equal scores rank by `tie`, without averaging; null if a class is missing (MT-10).

    Ranks come from counts: scores are cut into value groups, a running sum goes over blocks of them, so no task sorts all rows.
    """
    rows = df.select(F.col(score).alias("s"), truth(actual).alias("y"), F.col(tie).alias("t"))
    groups = rows.groupBy("s").agg(F.count("*").alias("n"))
    blocks = groups.withColumn("b", F.floor(F.col("s") * 4096)).groupBy("b").agg(F.sum("n").alias("bn"))
    ahead = blocks.withColumn("before_b", F.coalesce(F.sum("bn").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("bn")
    within = groups.withColumn("b", F.floor(F.col("s") * 4096)).withColumn("before_s", F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("t"))).join(within.join(ahead, "b").select("s", (F.col("before_b") + F.col("before_s")).alias("before")), "s")
    c = ranked.agg(F.sum(F.when(F.col("y"), F.col("r") + F.col("before"))).alias("r"), count_if(F.col("y")).alias("p"), count_if(~F.col("y")).alias("n"))
    return c.select(F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p").cast("double") * F.col("n"))).alias("auroc"))


def compare(results: DataFrame, baseline: str, lower_is_better: list[str]) -> DataFrame:
    """results(arm, metric, value) with delta to the baseline arm, positive where better (MT-13)."""
    base = results.where(F.col("arm") == baseline).select("metric", F.col("value").alias("base"))
    sign = F.when(F.col("metric").isin(lower_is_better), -1.0).otherwise(1.0)
    return results.join(base, "metric").select("arm", "metric", "value", (sign * (F.col("value") - F.col("base"))).alias("delta"))


class Evaluator:
    """Holds prediction tables of several batches and reports on all of them; metrics without input columns are left out (MT-12)."""

    def __init__(self, appliance="appliance", window="window", tolerance: int = 8):
        self.appliance, self.window, self.tolerance = appliance, window, tolerance
        self.reset()

    def update(self, df: DataFrame) -> None:
        self.parts.append(df)

    def update_events(self, predicted: DataFrame, actual: DataFrame) -> None:
        """Both (channel_id, k); channels of different batches differ."""
        self.events.append((predicted.select("channel_id", "k"), actual.select("channel_id", "k")))

    def reset(self) -> None:
        self.parts, self.events = [], []

    def frame(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out

    def event_metrics(self) -> dict[str, float]:
        if not self.events:
            return {}
        predicted, actual = (reduce(DataFrame.unionByName, x) for x in zip(*self.events))
        got = match.event_counts(predicted, actual, "channel_id", self.tolerance).first().asDict()
        return {f"event_{k}": v for k, v in got.items()}

    def compute(self) -> dict[str, float]:
        if not self.parts:
            return self.event_metrics()
        df = self.frame()
        has, out = set(df.columns), {}
        if {"presence_pred", "presence"} <= has:
            out |= detection_f1(df, "presence_pred", "presence", self.appliance).first().asDict() | matthews(df, "presence_pred", "presence").first().asDict()
            each = confusion(df, "presence_pred", "presence", [self.appliance]).select(self.appliance, f1().alias("f")).collect()
            out |= {f"f1:{r[0]}": r[1] for r in each}
        if {"power_pred", "power"} <= has:
            out |= power_metrics(df, "power_pred", "power", self.appliance, self.window, "power_mask" if "power_mask" in has else None).first().asDict()
        if {"presence_pred", "presence", "power_pred", "power"} <= has:
            out |= joint_metrics(df, "power_pred", "power", "presence_pred", "presence").first().asDict()
        if {"probability", "presence"} <= has:
            out |= calibration_error(df, "probability", "presence").first().asDict()
        if {"unknown_score", "is_unknown", self.window} <= has:
            out |= unknown_auroc(df.select(self.window, "unknown_score", "is_unknown").distinct(), "unknown_score", "is_unknown", self.window).first().asDict()
        return out | self.event_metrics()

    def report(self) -> str:
        return format_table([{"metric": k, "value": v} for k, v in self.compute().items()])


def format_table(rows: list[dict]) -> str:
    """Aligned text."""
    if not rows:
        return ""
    heads = list(rows[0])
    text = [[f"{r[h]:.4f}" if isinstance(r[h], float) else str(r[h]) for h in heads] for r in rows]
    width = [max(len(h), *(len(t[i]) for t in text)) for i, h in enumerate(heads)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(line, width)).rstrip() for line in [heads, *text])
