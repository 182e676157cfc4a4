"""Benchmarks of detectors: mains and sub-meters on one clock (JN-10), and the best setting of each detector (SL-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap_counts(mains: DataFrame, submeters: DataFrame, seconds: float) -> DataFrame:
    """mains(house, run, t0, fs, n) with the number of sub-meter runs that overlap each by more than `seconds`.

    A run that is longer than `seconds` overlaps one that is longer too, unless it begins too late or ends too early, and never both: so the
    count is a difference of two ranks, with one sort a house and no join of ranges.
    """
    end = F.col("t0") + F.col("n") / F.col("fs")
    m = mains.select("house", "run", F.col("t0").alias("_a"), end.alias("_b"))
    s = submeters.select("house", F.col("t0").alias("_a"), end.alias("_b")).where(F.col("_b") - F.col("_a") > seconds)

    def ranked(asked, own, asked_first: bool, name: str) -> DataFrame:
        points = m.select("house", "run", asked.alias("_t"), F.lit(0 if asked_first else 1).alias("_o")).unionByName(s.select("house", own.alias("_t"), F.lit(1 if asked_first else 0).alias("_o")), allowMissingColumns=True)
        w = Window.partitionBy("house").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
        mine = F.lit(1 if asked_first else 0)
        counted = points.withColumn(name, F.sum((F.col("_o") == mine).cast("long")).over(w))
        return counted.where(F.col("_o") != mine).select("house", "run", name)

    begun = ranked(F.col("_b") - seconds, F.col("_a"), True, "_begun")  # begin before the mains run's end less `seconds`
    ended = ranked(F.col("_a") + seconds, F.col("_b"), False, "_ended")  # end by its begin plus `seconds`
    both = mains.join(begun, ["house", "run"]).join(ended, ["house", "run"])
    longer = F.col("n") / F.col("fs") > seconds
    return both.withColumn("overlaps", F.when(longer, F.col("_begun") - F.col("_ended")).otherwise(F.lit(0).cast("long"))).drop("_begun", "_ended")


def benchmark_runs(mains: DataFrame, submeters: DataFrame, hours: float = 24.0, seconds: float = 3600.0) -> DataFrame:
    """Of each house the mains run with the most overlapping sub-meter runs; then the longest, then the first: (house, run, t0, fs, count)."""
    best = Window.partitionBy("house").orderBy(F.col("overlaps").desc(), F.col("n").desc(), "t0", "run")
    top = overlap_counts(mains, submeters, seconds).withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return top.select("house", "run", "t0", "fs", F.least(F.col("n"), F.floor(hours * 3600 * F.col("fs"))).cast("long").alias("count"))


def aligned(mains: DataFrame, submeters: DataFrame, series: DataFrame, hours: float = 24.0, seconds: float = 3600.0) -> DataFrame:
    """(house, appliance, k, p): the sub-meters' watts on the clock of the chosen mains run, 0 where nothing was measured.

    mains(house, run, t0, fs, n); submeters(house, appliance, run, t0, fs, n); series(house, appliance, run, k, p). A run is shifted by whole samples;
    of two runs of one appliance on one sample the later holds. An appliance stays if its runs cover more than 1 % of the window.
    """
    chosen = benchmark_runs(mains, submeters, hours, seconds).select("house", F.col("t0").alias("_t0"), F.col("fs").alias("_fs"), "count")
    shift = F.rint((F.col("t0") - F.col("_t0")) * F.col("_fs")).cast("long")
    moved = submeters.join(chosen, "house").withColumn("_shift", shift)
    skip, at = F.greatest(-F.col("_shift"), F.lit(0)), F.greatest(F.col("_shift"), F.lit(0))
    moved = moved.withColumn("_len", F.least(F.col("n") - skip, F.col("count") - at)).where("_len > 0")
    kept = moved.groupBy("house", "appliance", "count").agg(F.sum("_len").alias("_covered")).where(F.col("_covered") > F.floor(F.col("count") / 100)).select("house", "appliance", "count")
    place = moved.select("house", "appliance", "run", "t0", "_shift", "count")
    there = series.join(place, ["house", "appliance", "run"]).withColumn("k", F.col("k") + F.col("_shift")).where("k >= 0 and k < count")
    there = there.groupBy("house", "appliance", "k").agg(F.max_by("p", F.struct("t0", "run")).alias("p"))
    grid = kept.select("house", "appliance", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("k"))
    return grid.join(there, ["house", "appliance", "k"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def best_settings(scores: DataFrame, by: list[str], setting: str, score: str, position: str) -> DataFrame:
    """Of each detector the setting with the largest score, the first of the grid among equal ones; rows without a score do not count."""
    first = F.struct(F.col(score), -F.col(position))
    return scores.where(F.col(score).isNotNull()).groupBy(*by).agg(F.max_by(setting, first).alias(setting), F.max(score).alias(score))


def sweep(scored: dict, by: str, setting: str) -> DataFrame:
    """One table of several results: scored, by (name, setting) in the grid's order, the DataFrame of each; adds both and the position."""
    out = None
    for at, ((name, value), df) in enumerate(scored.items()):
        part = df.withColumns({by: F.lit(name), setting: F.lit(value).cast("double"), "position": F.lit(at).cast("long")})
        out = part if out is None else out.unionByName(part)
    return out
