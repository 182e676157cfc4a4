"""Superposition of loads and jitter (AU-*)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.electrical import array_active_power, mean, total


def added(a, b) -> Column:
    return F.zip_with(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b, lambda x, y: x + y)


def superposed(base: DataFrame, partners: DataFrame, on: list[str]) -> DataFrame:
    """base with one partner window added.

    Both hold v and i (or p), p_total, presence, power, power_mask, is_unknown; a base row has one partner of equal `on`. p_total is measured on the
    sum, under the base's voltage; the partner's powers are scaled to what it adds under that voltage; presence is the maximum, the mask the conjunction.
    """
    waves = "i" in base.columns
    cols = (["i"] if waves else ["p"]) + ["presence", "power", "power_mask", "is_unknown"]
    joined = base.join(partners.select(*on, *(F.col(c).alias(f"_o_{c}") for c in cols)), on)
    if waves:
        now = joined.withColumn("_add", array_active_power("v", "_o_i")).withColumn("i", added("i", "_o_i")).withColumn("p_total", array_active_power("v", "i"))
    else:
        now = joined.withColumn("_add", mean(F.col("_o_p"))).withColumn("p", added("p", "_o_p")).withColumn("p_total", mean(F.col("p")))
    scale = F.col("_add") / F.greatest(total(F.col("_o_power")), F.lit(1e-12))
    return (
        now.withColumn("power", F.zip_with("power", "_o_power", lambda x, y: x + y * scale))
        .withColumn("presence", F.zip_with("presence", "_o_presence", lambda x, y: F.greatest(x, y)))
        .withColumn("power_mask", F.zip_with("power_mask", "_o_power_mask", lambda x, y: x & y))
        .withColumn("is_unknown", F.col("is_unknown") | F.col("_o_is_unknown"))
        .drop("_add", *(f"_o_{c}" for c in cols))
    )


def partner_plan(window_idx: list[int], pool: dict[int, str], channel: dict[int, str], k: tuple[int, int] = (2, 3), p: float = 1.0, seed: int = 0, epoch: int = 0, max_tries: int = 16) -> list[tuple[int, int, int]]:
    """(window_idx, order, partner): the seeded draws of (seed, epoch, window_idx), never a used channel. pool: window to channel."""
    ids = np.array(sorted(pool))
    out = []
    for w in window_idx:
        rng = np.random.default_rng((seed, epoch, w))
        if rng.random() > p:
            continue
        n = int(rng.integers(k[0], k[1] + 1))
        used = [channel[w]]
        if n <= 1 or len(ids) < 2:
            continue
        for order in range(n - 1):
            found = None
            for _ in range(max_tries):
                other = int(ids[rng.integers(len(ids))])
                if pool[other] not in used:
                    found = other
                    break
            if found is None:
                break
            used.append(pool[found])
            out.append((w, order, found))
    return out


def partner_plans(windows: DataFrame, pool: DataFrame, k: tuple[int, int] = (2, 3), p: float = 1.0, seed: int = 0, epoch: int = 0, max_tries: int = 16) -> DataFrame:
    """The rows of partner_plan() as a DataFrame (window_idx, order, partner), for windows of any number.

    windows, pool: (window_idx, channel_id); window_idx is unique and not null, and a null channel is a channel. All draws that a window may
    need are made at once; they are ranks in the pool's order, so partners come by one equi-join and a fold over a window's few draws.
    Ranks are places in a block of 4,096 ids, and what comes before a block: only the blocks' counts are summed in one task.
    """
    size = pool.count()
    ids, wanted = "window_idx", (k[1] - 1) * max_tries
    if size < 2 or wanted < 1:
        return windows.sparkSession.createDataFrame([], "window_idx long, order int, partner long")

    def draw(batches):
        for batch in batches:
            rows = []
            for w in batch[ids].tolist():
                rng = np.random.default_rng((seed, epoch, w))
                n = 0 if rng.random() > p else int(rng.integers(k[0], k[1] + 1))
                rows.append((n, [int(rng.integers(size)) for _ in range((n - 1) * max_tries)]))
            yield batch.assign(n=[n for n, _ in rows], ranks=[r for _, r in rows])

    block = F.floor(F.col(ids) / 4096)
    before = pool.groupBy(block.alias("block")).count().select("block", F.coalesce(F.sum("count").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("partner")) - 1
    ranked = pool.select(block.alias("block"), F.col(ids).alias("partner"), F.col("channel_id").alias("other")).withColumn("place", place).join(before, "block").select((F.col("before") + F.col("place")).alias("rank"), "partner", "other")
    kind = windows.schema["channel_id"].dataType.simpleString()
    drawn = windows.select(F.col(ids).cast("long").alias(ids), "channel_id").mapInPandas(draw, f"window_idx long, channel_id {kind}, n int, ranks array<long>")
    tries = drawn.where("n > 1").select(ids, "channel_id", "n", F.posexplode("ranks").alias("at", "rank")).join(ranked, "rank")
    rows = tries.groupBy(ids, "channel_id", "n").agg(F.array_sort(F.collect_list(F.struct("at", "partner", "other"))).alias("draws"))

    def step(a, d):
        fresh = ~F.exists(a["used"], lambda u: u.eqNullSafe(d["other"]))
        hit = F.struct(F.concat(a["used"], F.array(d["other"])).alias("used"), F.concat(a["out"], F.array(d["partner"])).alias("out"), F.lit(0).alias("missed"))
        miss = F.struct(a["used"].alias("used"), a["out"].alias("out"), (a["missed"] + 1).alias("missed"))
        return F.when((a["missed"] >= max_tries) | (F.size(a["out"]) >= F.col("n") - 1), a).when(fresh, hit).otherwise(miss)

    start = F.struct(F.array("channel_id").alias("used"), F.array().cast("array<bigint>").alias("out"), F.lit(0).alias("missed"))
    return rows.select(ids, F.posexplode(F.aggregate("draws", start, step, lambda a: a["out"])).alias("order", "partner"))


def mixed(windows: DataFrame, plan: DataFrame, rounds: int) -> DataFrame:
    """windows(window_idx, ...) with the plan's (window_idx, order, partner) added in order; n_components counts all parts."""
    out = windows.withColumn("n_components", F.lit(1).cast("long"))
    for order in range(rounds):
        step = plan.where(F.col("order") == order).select("window_idx", "partner")
        chosen = step.join(windows.withColumnRenamed("window_idx", "partner"), "partner").drop("partner")
        more = superposed(out.join(step.select("window_idx"), "window_idx", "left_semi"), chosen, ["window_idx"]).withColumn("n_components", F.col("n_components") + 1)
        out = out.join(step.select("window_idx"), "window_idx", "left_anti").unionByName(more.select(*out.columns))
    return out


def normal(seed: int, *keys) -> Column:
    """A standard normal number that depends on seed and keys alone, by Box and Muller from two hashes."""
    u = lambda s: (F.pmod(F.xxhash64(F.lit(seed), F.lit(s), *keys), F.lit(2**52)).cast("double") + 1) / (2.0**52 + 1)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))


def voltage_jitter(df: DataFrame, sigma: float, seed: int, keys: list[str]) -> DataFrame:
    """V times s, I over s: powers stay."""
    s = 1 + sigma * normal(seed, *map(F.col, keys))
    return df.withColumn("_s", s).withColumns({"v": F.transform("v", lambda x: x * F.col("_s")), "i": F.transform("i", lambda x: x / F.col("_s"))}).drop("_s")


def gain_jitter(df: DataFrame, sigma: float, seed: int, keys: list[str]) -> DataFrame:
    """V and I times g = exp(normal): powers times g squared; p times g."""
    out = df.withColumn("_g", F.exp(sigma * normal(seed, *map(F.col, keys))))
    waves = "v" in df.columns
    for c in ("v", "i", "p"):
        if c in df.columns:
            out = out.withColumn(c, F.transform(c, lambda x: x * F.col("_g")))
    by = F.col("_g") * F.col("_g") if waves else F.col("_g")
    if "power" in df.columns:
        out = out.withColumn("power", F.transform("power", lambda x: x * by))
    if "p_total" in df.columns:
        out = out.withColumn("p_total", F.col("p_total") * by)
    return out.drop("_g")


def compose(*steps):
    """One function of a DataFrame that applies all in order."""

    def run(df):
        for step in steps:
            df = step(df)
        return df

    return run
