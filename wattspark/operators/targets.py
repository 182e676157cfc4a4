"""Joins between aggregate and sub-metered channels, and window targets (JN-01 to JN-06, WV-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SITE = ["dataset", "house", "session"]
DEFAULT_ON_WATTS = 10.0


def siblings(channels: DataFrame) -> DataFrame:
    """(channel_id, sibling_id): other channels of one dataset, house and session; null never equals null (JN-01)."""
    other = channels.select(*SITE, F.col("channel_id").alias("sibling_id"))
    return channels.select(*SITE, "channel_id").join(other, SITE).where("channel_id != sibling_id").select("channel_id", "sibling_id")


def sibling_power(windows: DataFrame, mains: DataFrame, submeters: DataFrame, series: DataFrame) -> DataFrame:
    """Mean watts of each sub-meter over each mains window (JN-02).

    windows(channel_id, start, length); mains and submeters: rows of channels; series(channel_id, k, p) of sub-meters. Samples
    floor((begin - t0) * fs) to ceil((end - t0) * fs), within the recording; no row where there is none. The mean leaves out nulls.

    Each window adds its own samples, by k: differences of a channel's prefix sums carry its earlier samples' rounding, and a mean of just a threshold
    falls on either side. A sample is read once a window that holds it.
    """
    m = mains.select(*SITE, "channel_id", F.col("fs").alias("_fs"), F.col("t0").alias("_t0"))
    s = submeters.select(*SITE, F.col("channel_id").alias("sibling_id"), "appliance", F.col("fs").alias("_sfs"), F.col("t0").alias("_st0"), F.col("n_samples").alias("_n"))
    spans = windows.join(m, "channel_id").join(s, SITE)
    begin, end = F.col("_t0") + F.col("start") / F.col("_fs"), F.col("_t0") + (F.col("start") + F.col("length")) / F.col("_fs")
    first = F.greatest(F.floor((begin - F.col("_st0")) * F.col("_sfs")), F.lit(0))
    last = F.least(F.ceil((end - F.col("_st0")) * F.col("_sfs")), F.col("_n"))
    spans = spans.select("channel_id", "start", "length", "sibling_id", "appliance", first.alias("_a"), last.alias("_b")).where("_b - _a >= 1")
    samples = spans.withColumn("k", F.explode(F.expr("sequence(_a, _b - 1)"))).join(series.select(F.col("channel_id").alias("sibling_id"), "k", "p"), ["sibling_id", "k"])
    w = Window.partitionBy("channel_id", "start", "length", "sibling_id", "appliance").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("watts", F.avg("p").over(w)).where("k = _b - 1").select("channel_id", "start", "length", "sibling_id", "appliance", "watts")


def activation_overlap(windows: DataFrame, activations: DataFrame) -> DataFrame:
    """(channel_id, start, length, appliance): activations that cover more than half of a window (JN-05)."""
    joined = windows.join(activations, "channel_id")
    overlap = F.least(F.col("start") + F.col("length"), F.col("off")) - F.greatest("start", "on")
    return joined.where(overlap > 0.5 * F.col("length")).select("channel_id", "start", "length", "appliance").distinct()


def run_containing(points: DataFrame, runs: DataFrame, key: str, t: str, default: str = "hf_only") -> DataFrame:
    """points with the session of the first run [start, stop], both ends counted, that holds t; else the default (JN-04).

    Runs of one key do not overlap, so the newest run that begins at or before t is the only candidate: an as-of join, no range join.
    """
    from .timeseries import asof_backward

    right = runs.select(key, F.col("start").alias(t), "stop", "session")
    found = asof_backward(points, right, [key], t, ["stop", "session"])
    return found.withColumn("session", F.when(F.col("stop") >= F.col(t), F.col("session")).otherwise(F.lit(default))).drop("stop")


def targets(windows: DataFrame, channels: DataFrame, appliances: DataFrame, p_total: DataFrame, watts: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Long targets (channel_id, start, appliance, presence, power, power_mask) and is_unknown (WV-11).

    appliances(appliance, on_threshold_w, is_known). A sub-meter window knows all appliances: its own by p_total(channel_id, start, p_total), others 0.
    A mains window knows the siblings that were recorded (watts from sibling_power); annotated overlaps add presence alone.
    """
    known = appliances.where("is_known").select("appliance", "on_threshold_w")
    keyed = windows.join(channels.select("channel_id", "kind", F.col("appliance").alias("own")), "channel_id")
    space = known.groupBy().agg(F.sort_array(F.collect_list(F.struct("appliance", "on_threshold_w"))).alias("_space"))  # one row: the vocabulary
    labels = keyed.crossJoin(space).withColumn("_s", F.explode("_space")).select(*keyed.columns, "_s.*")
    unknown = appliances.where("not is_known").select("appliance")
    held = keyed.join(unknown.withColumnRenamed("appliance", "own"), "own", "left_semi").where("kind = 'submeter'").select("channel_id", "start", F.lit(True).alias("_held"))
    loud = watts.join(unknown, "appliance", "left_semi").where(F.col("watts") > DEFAULT_ON_WATTS).select("channel_id", "start")
    marked = overlaps.join(unknown, "appliance", "left_semi").select("channel_id", "start")
    odd = loud.union(marked).distinct().withColumn("_odd", F.lit(True))
    rows = labels.join(p_total, ["channel_id", "start"], "left").join(watts.groupBy("channel_id", "start", "appliance").agg(F.max_by("watts", "sibling_id").alias("watts")), ["channel_id", "start", "appliance"], "left")
    rows = rows.join(overlaps.withColumn("_on", F.lit(True)).drop("length"), ["channel_id", "start", "appliance"], "left").join(held, ["channel_id", "start"], "left").join(odd, ["channel_id", "start"], "left")
    sub, mine, heldout = F.col("kind") == "submeter", F.col("own") == F.col("appliance"), F.coalesce("_held", F.lit(False))
    power = F.when(sub, F.when(mine & ~heldout, F.col("p_total")).otherwise(0.0)).otherwise(F.coalesce("watts", F.lit(0.0)))
    mask = F.when(sub, ~heldout & F.col("own").isNotNull()).otherwise(F.col("watts").isNotNull())
    presence = F.coalesce((power > F.col("on_threshold_w")) & mask, F.lit(False)) | (~sub & F.coalesce("_on", F.lit(False)))
    return rows.select("channel_id", "start", "appliance", presence.cast("double").alias("presence"), F.coalesce(power, F.lit(0.0)).alias("power"), F.coalesce(mask, F.lit(False)).alias("power_mask"), (heldout | F.coalesce("_odd", F.lit(False))).alias("is_unknown"))


def as_vectors(long: DataFrame) -> DataFrame:
    """Targets as arrays in the order of sorted appliances, a row a window."""
    s = F.array_sort(F.collect_list(F.struct("appliance", "presence", "power", "power_mask")))
    rows = long.groupBy("channel_id", "start").agg(s.alias("s"), F.max("is_unknown").alias("is_unknown"))
    return rows.select("channel_id", "start", *(F.transform("s", lambda x, c=c: x[c]).alias(c) for c in ("presence", "power", "power_mask")), "is_unknown")
