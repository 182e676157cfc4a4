"""The canonical store: Parquet tables channels, activations, appliances and chunked signals, and a manifest (SRC-16 to 18, SNK-01 to 04, AG-01 to 05)."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import align, labels


def chunked(series: DataFrame, keys: list[str], value: str, quantity: str, size: int = S.CHUNK) -> DataFrame:
    """Long rows (keys, k, value) to chunks of `size` samples; a chunk is gathered by itself, so memory is bounded by it."""
    rows = series.withColumn("chunk", F.floor(F.col("k") / size))
    packed = rows.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("k", F.col(value).cast("float").alias("x")))).alias("_s"))
    return packed.select(*keys, F.lit(quantity).alias("quantity"), "chunk", (F.col("chunk") * size).alias("start"), F.transform("_s", lambda s: s["x"]).alias("values"))


def unchunked(signals: DataFrame) -> DataFrame:
    """Chunks to long rows (channel_id, quantity, k, x)."""
    return signals.select("channel_id", "quantity", "start", F.posexplode("values").alias("_i", "_x")).select("channel_id", "quantity", (F.col("start") + F.col("_i")).alias("k"), F.col("_x").cast("double").alias("x"))


def hashed(signals: DataFrame) -> DataFrame:
    """(channel_id, sha256): of the sorted hashes of its chunks."""
    one = F.sha2(F.concat_ws("|", "quantity", F.col("start").cast("string"), F.concat_ws(",", F.transform("values", lambda x: x.cast("string")))), 256)
    return signals.select("channel_id", one.alias("h")).groupBy("channel_id").agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))), 256).alias("sha256"))


def with_ids(channels: DataFrame) -> DataFrame:
    """channel_id and instance_id where they are null; equal ids get #2, #3 and so on."""
    made = channels.withColumn("_base", F.coalesce("channel_id", labels.channel_id("dataset", "house", "session", "appliance", "kind")))
    w = Window.partitionBy("_base").orderBy(F.col("t0").asc_nulls_last(), F.col("n_samples"), F.col("instance_id"))
    n = F.row_number().over(w)
    return made.withColumn("_n", n).withColumn("channel_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("#", "_base", F.col("_n").cast("string")))).drop("_base", "_n").withColumn("instance_id", labels.instance_id("instance_id", "appliance", "brand", "dataset", "house", "session"))


def validated(channels: DataFrame) -> DataFrame:
    """Raises in the job on rows that are no recording: fs not over 0, a sub-meter without appliance, an unknown kind or quantity."""
    bad = F.when(~(F.col("fs") > 0), "fs must be over 0").when((F.col("kind") == "submeter") & F.col("appliance").isNull(), "a sub-meter names its appliance").when(~F.col("kind").isin(*S.KINDS), "unknown kind").when(F.exists("quantities", lambda q: ~q.isin(*S.QUANTITIES)), "unknown quantity")
    return channels.withColumn("fs", F.when(bad.isNull(), F.col("fs")).otherwise(F.raise_error(bad).cast("double")))


def filled_f0(channels: DataFrame, signals: DataFrame) -> DataFrame:
    """Where voltage is there and f0 is not: the estimate on the first chunk (SNK-02)."""
    heads = signals.where("quantity = 'v' and chunk = 0").select("channel_id", "values").join(channels.where("f0 is null").select("channel_id", "fs"), "channel_id")
    guess = heads.select("channel_id", (align.estimate_f0_udf(1.0)("values") * F.col("fs")).alias("_f0"))
    return channels.join(guess, "channel_id", "left").withColumn("f0", F.coalesce("f0", "_f0")).drop("_f0")


def write_store(path: str, channels: DataFrame, signals: DataFrame, activations: DataFrame | None = None, appliances: DataFrame | None = None, source: str = "", overwrite: bool = False) -> Store:
    """Writes a store; an existing one is refused unless overwrite."""
    spark = channels.sparkSession
    mode = "overwrite" if overwrite else "errorifexists"
    signals.select(*S.SIGNALS.names).write.mode(mode).partitionBy("quantity").parquet(f"{path}/signals")
    stored = spark.read.schema(S.SIGNALS).parquet(f"{path}/signals")
    stats = stored.groupBy("channel_id").agg(F.max(F.col("start") + F.size("values")).alias("_n"), F.array_sort(F.collect_set("quantity")).alias("_q"))
    made = channels.drop("n_samples", "quantities", "sha256").join(stats, "channel_id").withColumnRenamed("_n", "n_samples").withColumnRenamed("_q", "quantities").join(hashed(stored), "channel_id")
    validated(filled_f0(made, stored)).select(*S.CHANNELS.names).write.mode(mode).parquet(f"{path}/channels")
    acts = activations if activations is not None else spark.createDataFrame([], S.ACTIVATIONS)
    acts.select(*S.ACTIVATIONS.names).write.mode(mode).parquet(f"{path}/activations")
    table = appliances if appliances is not None else default_appliances(spark.read.parquet(f"{path}/channels"), acts)
    table.select(*S.APPLIANCES.names).write.mode(mode).parquet(f"{path}/appliances")
    store = Store(spark, path)
    store.write_manifest({"source": source})
    return store


def default_appliances(channels: DataFrame, activations: DataFrame) -> DataFrame:
    names = channels.select("appliance").union(activations.select("appliance")).where("appliance is not null").distinct()
    return names.select("appliance", F.lit(S.DEFAULT_ON_THRESHOLD_W).alias("on_threshold_w"), F.lit("unknown").alias("category"), F.lit(True).alias("is_known"))


class Store:
    """A lazy handle; a newer format is refused."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        if (version := self.manifest.get("format_version", S.FORMAT_VERSION)) > S.FORMAT_VERSION:
            raise ValueError(f"store format {version} is newer than {S.FORMAT_VERSION}")

    def _table(self, name, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    channels = property(lambda self: self._table("channels", S.CHANNELS))
    activations = property(lambda self: self._table("activations", S.ACTIVATIONS))
    appliance_table = property(lambda self: self._table("appliances", S.APPLIANCES))
    signals = property(lambda self: self._table("signals", S.SIGNALS))

    @property
    def manifest(self) -> dict:
        try:
            rows = self.spark.read.text(f"{self.path}/manifest").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise
        return json.loads(rows[0][0])

    def write_manifest(self, more: dict) -> None:
        t = self.channels.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_samples"), F.lit(0)).alias("s"), F.sha2(F.concat_ws("", F.array_sort(F.collect_list("sha256"))), 256).alias("h"), F.array_sort(F.collect_set("dataset")).alias("d")).first()
        body = {"format_version": S.FORMAT_VERSION, "created_utc": datetime.now(timezone.utc).isoformat(), "datasets": t["d"], "n_channels": t["n"], "n_appliances": self.appliance_table.count(), "total_samples": t["s"], "content_sha256": t["h"]} | more
        self.spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest")

    def submeters(self) -> DataFrame:
        return self.channels.where("kind = 'submeter'")

    def mains(self) -> DataFrame:
        return self.channels.where("kind = 'mains'")

    def channel(self, channel_id: str):
        row = self.channels.where(F.col("channel_id") == channel_id).head(1)
        if not row:
            raise KeyError(channel_id)
        return row[0]

    def activations_for(self, channel_id: str) -> DataFrame:
        return self.activations.where(F.col("channel_id") == channel_id)

    def signal(self, channel_id: str, quantity: str) -> DataFrame:
        """Long rows (k, x); the filter reaches the partition and the row groups."""
        return unchunked(self.signals.where((F.col("quantity") == quantity) & (F.col("channel_id") == channel_id))).select("k", "x")

    def has_quantity(self, channel_id: str, quantity: str) -> bool:
        return quantity in self.channel(channel_id)["quantities"]

    def read_window(self, channel_id: str, quantity: str, start: int, length: int) -> list[float]:
        """A copy; zeros past the end."""
        near = self.signals.where((F.col("quantity") == quantity) & (F.col("channel_id") == channel_id) & (F.col("start") < start + length) & (F.col("start") > start - S.CHUNK))
        out = [0.0] * length
        for r in unchunked(near).where((F.col("k") >= start) & (F.col("k") < start + length)).select("k", "x").collect():
            out[r["k"] - start] = r["x"]
        return out

    def measurement(self, channel_id: str, start: int = 0, seconds: float | None = None, samples: int | None = None):
        """A Measurement over a window of a channel; the whole of it without a length (PF-11)."""
        from .measurement import Measurement

        row = self.channel(channel_id)
        fs, length = row["fs"], row["n_samples"] - start
        if seconds is not None:
            length = min(length, int(seconds * fs))
        if samples is not None:
            length = min(length, samples)
        if length <= 0:
            raise ValueError(f"an empty window: {start} is past the end of {channel_id!r}")
        read = lambda q: self.read_window(channel_id, q, start, length)
        t0 = (row["t0"] or 0.0) + start / fs
        if {"v", "i"} <= set(row["quantities"]):
            return Measurement.from_vi(self.spark, read("v"), read("i"), fs, t0=t0, f0=row["f0"])
        if "p" in row["quantities"]:
            return Measurement.from_power(self.spark, read("p"), fs, t0=t0)
        raise KeyError(f"{channel_id!r} has {row['quantities']}, which is no measurement")

    def distinct(self, column: str) -> list[str]:
        return [r[0] for r in self.channels.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]

    def label_space(self) -> DataFrame:
        """(appliance, index, on_threshold_w, is_known) in sorted order (AG-04)."""
        return label_space(self.appliance_table)

    def describe(self) -> DataFrame:
        return describe(self.appliance_table, self.channels)

    def verify(self, deep: bool = False) -> DataFrame:
        """(channel_id, problem); empty if the store is whole (SNK-04)."""
        return verify(self.channels, self.signals, self.activations, self.appliance_table, deep)


def label_space(appliances: DataFrame) -> DataFrame:
    return appliances.withColumn("index", (F.row_number().over(Window.orderBy("appliance")) - 1).cast("long"))  # the vocabulary, a row an appliance


def describe(appliances: DataFrame, channels: DataFrame) -> DataFrame:
    """Per appliance: channels, instances, brands, hours; 0 where there is none (AG-01)."""
    stats = channels.groupBy("appliance").agg(F.count("*").alias("n_channels"), F.count_distinct("instance_id").alias("n_instances"), F.count_distinct("brand").alias("n_brands"), F.sum(F.col("n_samples") / F.col("fs") / 3600).alias("hours"))
    return appliances.select("appliance").join(stats, "appliance", "left").fillna(0)


def verify(channels: DataFrame, signals: DataFrame, activations: DataFrame, appliances: DataFrame, deep: bool) -> DataFrame:
    want = channels.select("channel_id", "n_samples", F.explode("quantities").alias("quantity"))
    have = signals.groupBy("channel_id", "quantity").agg(F.sum(F.size("values")).alias("n"))
    both = want.join(have, ["channel_id", "quantity"], "left")
    out = both.where("n is null").select("channel_id", F.concat(F.lit("missing signal "), "quantity").alias("problem"))
    out = out.unionByName(both.where("n != n_samples").select("channel_id", F.concat(F.lit("wrong length of "), "quantity").alias("problem")))
    named = channels.select("channel_id", "appliance").union(activations.select("channel_id", "appliance")).where("appliance is not null").distinct()
    out = out.unionByName(named.join(appliances, "appliance", "left_anti").select("channel_id", F.concat(F.lit("not in the table: "), "appliance").alias("problem")))
    if deep:
        out = out.unionByName(channels.select("channel_id", "sha256").join(hashed(signals).withColumnRenamed("sha256", "h"), "channel_id").where("h != sha256").select("channel_id", F.lit("wrong hash").alias("problem")))
    return out
