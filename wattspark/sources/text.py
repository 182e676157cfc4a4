"""Readers of corpora in text formats. Each gives a Recordings: channels, long samples and activations as DataFrames.

Files are read by Spark's own readers, one task a split; names carry metadata. Time ranges are filters on the time column, so they are applied
before runs and grids are made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import timeseries as T


@dataclass
class Recordings:
    """channels: CHANNELS columns but n_samples, quantities and sha256; samples(channel_id, quantity, k, x); activations."""

    channels: DataFrame
    samples: DataFrame
    activations: DataFrame | None = None
    #: The samples in chunks, where a reader has them so: (channel_id, quantity, chunk, start, values).
    signals: DataFrame | None = None

    def limited(self, n: int) -> Recordings:
        """The first n channels by id."""
        channels = self.channels.orderBy("channel_id").limit(n)
        own = lambda df: None if df is None else df.join(channels.select("channel_id"), "channel_id", "left_semi")
        return Recordings(channels, own(self.samples), own(self.activations), own(self.signals))

    def write(self, path: str, appliances: DataFrame | None = None, overwrite: bool = False):
        from ..plans import store

        if self.signals is not None:
            return store.write_store(path, self.channels, self.signals, self.activations, appliances, overwrite=overwrite)
        signals = None
        for q in ("v", "i", "p"):
            part = store.chunked(self.samples.where(F.col("quantity") == q), ["channel_id"], "x", q)
            signals = part if signals is None else signals.unionByName(part)
        return store.write_store(path, self.channels, signals, self.activations, appliances, overwrite=overwrite)


def slug(label: Column) -> Column:
    """Lower case, white space as _."""
    return F.regexp_replace(F.lower(F.trim(label)), r"\s+", "_")


def quantities(v: Column, i: Column) -> Column:
    """Rows struct(quantity, x) of both."""
    return F.explode(F.array(*(F.struct(F.lit(q).alias("quantity"), x.alias("x")) for q, x in (("v", v), ("i", i)))))


def numbered_lines(spark: SparkSession, path: str, schema: str, sep: str) -> DataFrame:
    """Rows of headerless CSV files with their file and line number. Line numbers come from the position in the file's splits: monotonic ids
    grow along a file, and are numbered within it."""
    rows = spark.read.schema(schema).csv(path, sep=sep).withColumns({"file": F.input_file_name(), "_id": F.monotonically_increasing_id()})
    return T.with_index(rows, "file", ["_id"]).drop("_id")


def file_stem(file: str = "file") -> Column:
    return F.regexp_extract(F.url_decode(F.col(file)), r"([^/]+)\.[^./]+$", 1)


def plaid(spark: SparkSession, path: str, metadata: str, fs: float | None = None) -> Recordings:
    """{id}.csv of current, voltage; metadata JSON {id: {header, appliance | appliances}} (SRC-01, SRC-02)."""
    item = "struct<header:struct<sampling_frequency:string,collection_time:string,notes:string>,location:string,campaign:string,appliance:struct<type:string,brand:string,model:string>,appliances:array<struct<type:string,on:string,off:string>>>"
    raw = spark.read.text(metadata, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{item}>")).alias("id", "m"))
    meta = raw.select("id", "m.*").where("appliance is not null or appliances is not null")
    rate = F.lit(float(fs)) if fs else F.regexp_extract("header.sampling_frequency", r"([0-9.]+)", 1).cast("double")
    lines = numbered_lines(spark, f"{path}/*.csv", "i double, v double", ",").withColumn("id", file_stem())
    sub = F.col("appliance").isNotNull()
    channels = meta.select("id", F.lit("plaid").alias("dataset"), F.coalesce("location", "campaign", F.lit("unknown")).alias("house"), F.col("id").alias("session"), F.when(sub, "submeter").otherwise("mains").alias("kind"), slug(F.col("appliance.type")).alias("appliance"), F.lower("appliance.brand").alias("brand"), F.lit(None).cast("string").alias("instance_id"), rate.alias("fs"), F.lit(60.0).alias("f0"), F.lit(0.0).alias("t0"), "appliances")
    channels = channels.withColumn("channel_id", labels.channel_id("dataset", "house", "session", "appliance", "kind"))
    samples = lines.join(channels.select("id", "channel_id"), "id").select("channel_id", "k", quantities(F.col("v"), F.col("i")).alias("s")).select("channel_id", "k", "s.*")
    counts = lines.groupBy("id").agg(F.count("*").alias("n"))
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)")), lambda x: x.cast("long"))
    acts = channels.where(~F.col("kind").eqNullSafe("submeter")).join(counts, "id").select("channel_id", "n", F.explode("appliances").alias("a")).select("channel_id", "n", slug(F.col("a.type")).alias("appliance"), numbers(F.col("a.on")).alias("on"), numbers(F.col("a.off")).alias("off"))
    # A missing end is the end of the recording; lists of different lengths are dropped.
    acts = acts.withColumn("off", F.when(F.size("off") == 0, F.transform("on", lambda _: F.col("n"))).otherwise(F.col("off"))).where(F.size("on") == F.size("off"))
    acts = acts.select("channel_id", "appliance", "n", F.explode(F.arrays_zip("on", "off")).alias("s")).select("channel_id", "appliance", F.greatest("s.on", F.lit(0)).alias("on"), F.least("s.off", "n").alias("off")).where("off > on").orderBy("appliance", "on")
    return Recordings(channels.join(counts.select("id"), "id", "left_semi").drop("id", "appliances"), samples, acts)


def meter_runs(readings: DataFrame, keys: list[str], fs: float, max_gap_s: float, dataset: str) -> Recordings:
    """readings(house, name, t seconds, w): gap runs, each forward-filled onto its grid and a channel of its own (SRC-04, ST-07: sorted by time)."""
    micro = readings.withColumn("t", F.round(F.col("t") * 1e6).cast("long")).withColumn("_c", F.concat_ws("\x1f", *keys))
    run = T.split_on_gaps(micro, "_c", "t", round(max_gap_s * 1e6))
    filled = T.forward_fill_to_grid(run, "_c", "t", "w", round(1e6 / fs))
    named = filled.join(readings.select(*keys).distinct().withColumn("_c", F.concat_ws("\x1f", *keys)), "_c")
    mains = F.lower("name").isin("aggregate", "mains")
    meta = named.groupBy("_c", "run", *keys).agg((F.min("t") / 1e6).alias("t0")).select("_c", "run", F.lit(dataset).alias("dataset"), F.col("house"), F.concat(F.lit("run_"), "run").alias("session"), F.when(mains, "mains").otherwise("submeter").alias("kind"), F.when(~mains, labels.normalise("name")).alias("appliance"), F.lit(None).cast("string").alias("brand"), F.lit(None).cast("string").alias("instance_id"), F.lit(float(fs)).alias("fs"), F.lit(None).cast("double").alias("f0"), "t0")
    base = labels.channel_id("dataset", "house", "session", "appliance", "kind")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("_b").orderBy("_c"))
    meta = meta.withColumn("_b", base).withColumn("_n", n).withColumn("channel_id", F.when(F.col("_n") == 1, F.col("_b")).otherwise(F.concat_ws("#", "_b", F.col("_n").cast("string")))).drop("_b", "_n")
    samples = filled.join(meta.select("_c", "run", "channel_id"), ["_c", "run"]).select("channel_id", F.lit("p").alias("quantity"), "k", F.col("w").cast("double").alias("x"))
    return Recordings(meta.drop("_c", "run"), samples)


def in_range(df: DataFrame, t: str, time_range: tuple[float, float] | None) -> DataFrame:
    return df.where(F.col(t).between(*time_range)) if time_range else df


def ukdale(spark: SparkSession, path: str, houses: list[int] | None = None, rate_hz: float = 1 / 6, max_gap_s: float = 300.0, time_range: tuple[float, float] | None = None) -> Recordings:
    """house_N/channel_M.dat of unix seconds and watts; labels.dat names the channels (SRC-04, SRC-06)."""
    where = r"house_(\d+)/[^/]*$"
    lines = spark.read.schema("t double, w double").csv(f"{path}/house_*/channel_*.dat", sep=" ").withColumn("file", F.input_file_name())
    rows = in_range(lines, "t", time_range).select("t", "w", F.regexp_extract("file", where, 1).alias("house"), F.regexp_extract("file", r"channel_(\d+)\.dat$", 1).alias("channel"))
    names = spark.read.schema("channel string, name string").csv(f"{path}/house_*/labels.dat", sep=" ").withColumn("house", F.regexp_extract(F.input_file_name(), where, 1))
    if houses:
        rows = rows.where(F.col("house").isin([str(h) for h in houses]))
    named = rows.join(names, ["house", "channel"], "left").withColumn("name", F.when(F.col("channel") == "1", "mains").otherwise(F.coalesce("name", F.concat(F.lit("channel_"), "channel"))))
    return meter_runs(named.withColumn("house", F.concat(F.lit("house_"), "house")), ["house", "name", "channel"], rate_hz, max_gap_s, "ukdale")


# Spellings that stand for one thing.
REFIT_SPELLINGS = {"dishwaser": "dishwasher", "firdge": "fridge", "fridge-freezer": "fridge_freezer"}


def refit_label(name: Column) -> Column:
    """Without brackets, as a slug, spellings mended (SRC-08)."""
    bare = F.lower(F.trim(F.regexp_replace(name, r"\(([^)]*)\)", "")))
    made = F.regexp_replace(F.regexp_replace(bare, "-", "_"), r"\s+", "_")
    table = F.create_map(*(F.lit(x) for kv in REFIT_SPELLINGS.items() for x in kv))
    return F.coalesce(table[made], table[bare], made)


def refit_qualifier(name: Column) -> Column:
    got = F.trim(F.regexp_extract(name, r"\(([^)]*)\)", 1))
    return F.when(got != "", got)


def refit(spark: SparkSession, path: str, appliances: str, houses: list[int] | None = None, rate_hz: float = 1 / 8, max_gap_s: float = 300.0, drop_issues: bool = True, max_seconds: float | None = None, time_range: tuple[float, float] | None = None) -> Recordings:
    """CLEAN_HouseN.csv, wide to long. appliances: a CSV of house, column, name, since the files do not name them (SRC-07)."""
    wide = spark.read.csv(f"{path}/CLEAN_House*.csv", header=True, inferSchema=True).withColumn("house", F.regexp_extract(F.input_file_name(), r"House(\d+)", 1).cast("int"))
    if drop_issues and "Issues" in wide.columns:
        wide = wide.where("Issues = 0")
    if houses:
        wide = wide.where(F.col("house").isin(houses))
    wide = in_range(wide, "Unix", time_range)
    if max_seconds is not None:
        wide = wide.join(wide.groupBy("house").agg(F.min("Unix").alias("_a")), "house").where(F.col("Unix") < F.col("_a") + max_seconds)
    values = [c for c in wide.columns if c == "Aggregate" or c.startswith("Appliance")]
    long = wide.select("house", F.col("Unix").cast("double").alias("t"), *(F.col(c).cast("double") for c in values)).unpivot(["house", "t"], values, "column", "w")
    names = spark.read.schema("house int, column string, name string").csv(appliances, header=True)
    named = long.join(names, ["house", "column"], "left").withColumn("name", F.when(F.col("column") == "Aggregate", "mains").otherwise(refit_label(F.coalesce("name", "column"))))
    return meter_runs(named.where("w is not null").withColumn("house", F.concat(F.lit("house_"), "house")), ["house", "name", "column"], rate_hz, max_gap_s, "refit")


# Columns, their names, and the factors to watts.
UCI_COLUMNS = {"Global_active_power": ("mains", 1000.0), "Sub_metering_1": ("kitchen_outlets", 60.0), "Sub_metering_2": ("laundry_room", 60.0), "Sub_metering_3": ("water_heater_air_conditioner", 60.0)}


def uci(spark: SparkSession, path: str, max_gap_s: float = 300.0, time_range: tuple[float, float] | None = None) -> Recordings:
    """One house a minute; ? is missing, which makes a gap and never a zero (SRC-09)."""
    raw = spark.read.csv(path, sep=";", header=True, nullValue="?")
    t = F.unix_timestamp(F.concat_ws(" ", "Date", "Time"), "d/M/yyyy H:m:s").cast("double")
    wide = in_range(raw.select(t.alias("t"), *(F.col(c).cast("double") for c in UCI_COLUMNS)), "t", time_range)
    long = wide.unpivot(["t"], list(UCI_COLUMNS), "column", "w").where("w is not null")
    factor = F.create_map(*(F.lit(x) for c, (_, f) in UCI_COLUMNS.items() for x in (c, f)))
    name = F.create_map(*(F.lit(x) for c, (n, _) in UCI_COLUMNS.items() for x in (c, n)))
    return meter_runs(long.select(F.lit("house_1").alias("house"), name[F.col("column")].alias("name"), "t", (F.col("w") * factor[F.col("column")]).alias("w")), ["house", "name"], 1 / 60, max_gap_s, "uci")


# Offset and scale of the stored converter output.
HIFDA_CALIBRATION = {"i": (1.6462, 12.55), "v": (1.5992, 33.64)}


def hifda(spark: SparkSession, path: str, fs: float = 100_000.0) -> Recordings:
    """Current/<class>/<stem>Current.txt and Voltage/<class>/<stem>Voltage.txt; halves without their other half go, the longer is cut (SRC-13)."""

    def half(kind: str, q: str) -> DataFrame:
        offset, scale = HIFDA_CALIBRATION[q]
        rows = numbered_lines(spark, f"{path}/{kind}/*/*.txt", "x double", "\x01")
        file = F.url_decode(F.col("file"))
        return rows.select(F.regexp_extract(file, rf"{kind}/([^/]+)/[^/]+$", 1).alias("class"), F.regexp_extract(file, rf"/([^/]+?){kind}\.txt$", 1).alias("stem"), "k", ((F.col("x") - offset) * scale).alias(q))

    both = half("Current", "i").join(half("Voltage", "v"), ["class", "stem", "k"])
    mains = F.regexp_replace(F.lower("class"), "[^a-z]", "") == "emptygrid"
    meta = both.select("class", "stem").distinct().select("class", "stem", F.lit("hifda").alias("dataset"), F.lit("house_1").alias("house"), F.col("stem").alias("session"), F.when(mains, "mains").otherwise("submeter").alias("kind"), F.when(~mains, slug(F.regexp_replace("class", "-", "_"))).alias("appliance"), F.lit(None).cast("string").alias("brand"), F.lit(None).cast("string").alias("instance_id"), F.lit(fs).alias("fs"), F.lit(50.0).alias("f0"), F.lit(0.0).alias("t0"))
    meta = meta.withColumn("channel_id", labels.channel_id("dataset", "house", "session", "appliance", "kind"))
    samples = both.join(meta.select("class", "stem", "channel_id"), ["class", "stem"]).select("channel_id", "k", quantities(F.col("v"), F.col("i")).alias("s")).select("channel_id", "k", "s.*")
    return Recordings(meta.drop("class", "stem"), samples)
