"""The built-in example: two houses, three sub-meters and exact-sum mains each, as column expressions (SRC-19)."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from .text import Recordings, quantities

FS, F0, SECONDS = 6000, 50.0, 2
# RMS amperes, amplitudes of harmonics 1 to 3, and phase lag.
LOADS = {"kettle": (9.0, (1.0, 0.02, 0.01), 0.02), "fridge": (0.9, (1.0, 0.12, 0.30), 0.55), "laptop": (0.4, (1.0, 0.55, 0.40), 0.35), "microwave": (6.0, (1.0, 0.30, 0.18), 0.30)}
HOUSES = {"house_1": ("acme", ("kettle", "fridge", "laptop")), "house_2": ("globex", ("kettle", "fridge", "microwave"))}


def voltage(k: Column) -> Column:
    return 230 * math.sqrt(2) * F.sin(2 * math.pi * F0 * k / FS)


def current(load: str, k: Column) -> Column:
    rms, amplitudes, lag = LOADS[load]
    scale = rms * math.sqrt(2) / math.sqrt(sum(a * a for a in amplitudes) / 2)
    out = F.lit(0.0)
    for h, a in enumerate(amplitudes, 1):
        out = out + scale * a * F.sin(2 * math.pi * F0 * h * k / FS - lag * h)
    return out


def example(spark: SparkSession) -> Recordings:
    k = spark.range(FS * SECONDS).withColumnRenamed("id", "k")
    parts, meta = [], []
    for house, (brand, loads) in HOUSES.items():
        total = F.lit(0.0)
        for load in loads:
            total = total + current(load, F.col("k"))
        if house == "house_1":
            total = total + 0.25 * current("laptop", F.col("k"))
        for name, i in [*((x, current(x, F.col("k"))) for x in loads), (None, total)]:
            meta.append(("example", house, "run_0", "submeter" if name else "mains", name, brand if name else None, None, float(FS), F0, 0.0))
            parts.append(k.select(F.lit(house).alias("house"), F.lit(name).cast("string").alias("appliance"), "k", quantities(voltage(F.col("k")), i).alias("s")).select("house", "appliance", "k", "s.*"))
    channels = spark.createDataFrame(meta, "dataset string, house string, session string, kind string, appliance string, brand string, instance_id string, fs double, f0 double, t0 double")
    channels = channels.withColumn("channel_id", labels.channel_id("dataset", "house", "session", "appliance", "kind")).withColumn("instance_id", labels.instance_id("instance_id", "appliance", "brand", "dataset", "house", "session"))
    samples = parts[0]
    for p in parts[1:]:
        samples = samples.unionByName(p)
    ids = channels.select("house", F.coalesce("appliance", F.lit("")).alias("_a"), "channel_id")
    samples = samples.withColumn("_a", F.coalesce("appliance", F.lit(""))).join(ids, ["house", "_a"]).select("channel_id", "quantity", "k", "x")
    return Recordings(channels, samples)
