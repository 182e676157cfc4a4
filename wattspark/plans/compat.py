"""What keeps stores from being used together, and merging them (AG-07 to AG-09, CP, SNK-05, SNK-06)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from . import store as ST

VIEWS = ("aligned", "raw", "lowfreq")
# The views that an axis breaks where it varies, and those that it narrows to the channels that can serve them.
BLOCKS = {"fs": ["raw"], "f0": ["raw"], "quantities": [], "vocabulary": [], "voltage": ["aligned", "raw", "lowfreq"], "dataset": []}
NARROWS = {"fs": [], "f0": [], "quantities": ["aligned", "raw"], "vocabulary": [], "voltage": [], "dataset": []}


def axes(channels: DataFrame) -> DataFrame:
    """(axis, values): distinct rates to 4 digits, f0 to 2, sets of quantities, appliances and datasets, as sorted texts."""
    pairs = F.array(
        F.struct(F.lit("fs").alias("axis"), F.bround("fs", 4).cast("string").alias("value")),
        F.struct(F.lit("f0").alias("axis"), F.bround("f0", 2).cast("string").alias("value")),
        F.struct(F.lit("quantities").alias("axis"), F.concat_ws(",", "quantities").alias("value")),
        F.struct(F.lit("vocabulary").alias("axis"), F.col("appliance").alias("value")),
        F.struct(F.lit("dataset").alias("axis"), F.col("dataset").alias("value")),
    )
    long = channels.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null")
    return long.distinct().groupBy("axis").agg(F.array_sort(F.collect_list("value")).alias("values"))


def clusters(values: Column, tolerance: float) -> Column:
    """Means of groups of a sorted array: a value joins while it is at most first * (1 + tolerance) (AG-08)."""
    kind = "array<struct<first:double,sum:double,n:bigint>>"
    one = lambda v: F.array(F.struct(v.alias("first"), v.alias("sum"), F.lit(1).cast("long").alias("n")))

    def step(a, v):
        last = F.element_at(a, -1)
        joins = (F.size(a) > 0) & (v <= last["first"] * (1 + tolerance))
        more = F.struct(last["first"].alias("first"), (last["sum"] + v).alias("sum"), (last["n"] + 1).alias("n"))
        return F.when(joins, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(a, one(v)))

    return F.transform(F.aggregate(F.array_sort(values), F.array().cast(kind), step), lambda c: c["sum"] / c["n"])


def supply_voltages(signals: DataFrame, head: int = 4096) -> DataFrame:
    """(channel_id, vrms) over the first samples."""
    v = ST.unchunked(signals.where("quantity = 'v' and start < %d" % head)).where(F.col("k") < head)
    return v.groupBy("channel_id").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("vrms"))


def supports(view: str = "aligned", rate_hz: float = 1.0) -> Column:
    """Can a view be made of a channel? Waveform views need v and i and fs >= 2 f0; low-rate ones v and i, or p, and fs >= rate (PF-05)."""
    has = lambda q: F.array_contains("quantities", q)
    f0 = F.coalesce(F.nanvl("f0", F.lit(50.0)), F.lit(50.0))
    if view in ("aligned", "raw"):
        return has("v") & has("i") & (F.col("fs") >= 2 * f0)
    if view == "apparent":
        return has("v") & has("i") & (F.col("fs") >= rate_hz)
    return ((has("v") & has("i")) | has("p")) & (F.col("fs") >= rate_hz)


def view_name(view) -> str:
    """The name of a view, which may be given as an object."""
    if isinstance(view, str):
        return view
    if hasattr(view, "aligned"):
        return "aligned" if view.aligned else "raw"
    return "lowfreq"


def usable_counts(channels: DataFrame) -> dict[str, int]:
    """Of each view, the channels that hold its quantities; and all channels."""
    waves = F.array_contains("quantities", "v") & F.array_contains("quantities", "i")
    one = lambda c: F.count(F.when(c, 1))
    return channels.agg(one(waves).alias("aligned"), one(waves).alias("raw"), one(waves | F.array_contains("quantities", "p")).alias("lowfreq"), F.count("*").alias("all")).first().asDict()


@dataclass
class CompatibilityReport:
    """values: by axis; n_stores; n_usable: channels by view, and all."""

    values: dict[str, list[str]]
    n_stores: int
    n_usable: dict[str, int]

    def axis(self, name: str) -> list[str]:
        if name not in BLOCKS:
            raise KeyError(f"unknown axis {name!r}; there are {sorted(BLOCKS)}")
        return self.values.get(name, [])

    def varying(self) -> list[str]:
        return sorted(k for k, v in self.values.items() if len(v) > 1)

    def blocking(self, view="aligned") -> list[str]:
        return [k for k in self.varying() if view_name(view) in BLOCKS[k]]

    def partial(self, view="aligned") -> list[str]:
        """Axes that narrow the view to some of the channels."""
        return [k for k in self.varying() if view_name(view) in NARROWS[k]]

    def usable(self, view="aligned") -> int:
        return self.n_usable[view_name(view)]

    def is_compatible(self, view="aligned") -> bool:
        return not self.blocking(view) and self.usable(view) > 0

    def to_frame(self):
        """A pandas table, one row an axis; six values at most are shown."""
        import pandas as pd

        rows = [{"axis": k, "distinct": len(v), "values": v if len(v) <= 6 else [*v[:6], "..."], "blocks": ", ".join(BLOCKS[k]) or "-", "narrows": ", ".join(NARROWS[k]) or "-"} for k, v in sorted(self.values.items())]
        return pd.DataFrame(rows, columns=["axis", "distinct", "values", "blocks", "narrows"])

    def verdict(self, view="aligned") -> str:
        n, every = self.usable(view), self.n_usable["all"]
        if blockers := self.blocking(view):
            return "blocked by " + ", ".join(blockers)
        return "no channel can serve it" if n == 0 else f"ok on all {every} channels" if n == every else f"ok on {n} of {every} channels"

    def summary(self) -> str:
        lines = [f"{v}: {self.verdict(v)}" for v in VIEWS]
        return "\n".join(lines + [f"{k}: {'varies: ' if len(v) > 1 else ''}{', '.join(v)}" for k, v in sorted(self.values.items())])


def compatibility(*stores: ST.Store, deep: bool = True, voltage_tolerance: float = 0.05) -> CompatibilityReport:
    """Supply voltages of at most 1 V are no supply and do not count."""
    channels = reduce(DataFrame.unionByName, (s.channels for s in stores))
    values = {r["axis"]: r["values"] for r in axes(channels).collect()}
    if deep:
        v = reduce(DataFrame.unionByName, (supply_voltages(s.signals) for s in stores)).where("vrms > 1").agg(clusters(F.collect_set(F.bround("vrms", 3)), voltage_tolerance).alias("c")).first()[0]
        values["voltage"] = [f"{x:.1f}" for x in v or []]
    return CompatibilityReport(values, len(stores), usable_counts(channels))


def voltage_scale(signals: DataFrame, channels: DataFrame, target: float) -> DataFrame:
    """(channel_id, scale): target over the RMS of whole cycles in about the first second; 1 where that is at most 1 V."""
    f0 = F.coalesce(F.nanvl("f0", F.lit(50.0)), F.lit(50.0))
    heads = channels.select("channel_id", F.floor(F.floor(F.least(F.col("fs"), F.col("n_samples").cast("double")) * f0 / F.col("fs")) * F.col("fs") / f0).alias("_m"))
    v = ST.unchunked(signals.where("quantity = 'v'")).join(heads, "channel_id").where(F.col("k") < F.col("_m"))
    r = v.groupBy("channel_id").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("_r"))
    return r.select("channel_id", F.when(F.col("_r") > 1, target / F.col("_r")).otherwise(1.0).alias("scale"))


def merge_stores(sources: list[ST.Store], path: str, require: list[str] | None = None, taxonomy: labels.Taxonomy | None = None, rename: dict[str, str] | None = None, normalize_voltage: float | None = None, prefix_with_dataset: bool = True, overwrite: bool = False) -> ST.Store:
    """One store of several: labels harmonised, voltages scaled (currents inversely, so that powers stay), the last source's thresholds."""
    report = compatibility(*sources, deep="voltage" in (require or []) and not normalize_voltage)
    for name in require or []:
        if len(report.axis(name)) > 1 and not (name == "voltage" and normalize_voltage):
            raise ValueError(f"{name} differs: {report.axis(name)}")
    tables, signals, acts, names = [], [], [], []
    for n, s in enumerate(sources):
        fresh = F.concat_ws(":", "dataset", "channel_id") if prefix_with_dataset else F.col("channel_id")
        ids = s.channels.select("channel_id", fresh.alias("_new"), "dataset")
        tables.append(labels.relabelled(s.channels, "appliance", taxonomy, rename, "dataset").join(ids.drop("dataset"), "channel_id").withColumn("channel_id", F.col("_new")).drop("_new"))
        own = s.signals
        if normalize_voltage:
            scale = voltage_scale(s.signals, s.channels, normalize_voltage)
            own = own.join(scale, "channel_id", "left").withColumn("_s", F.coalesce("scale", F.lit(1.0)))
            by = F.when(F.col("quantity") == "v", F.col("_s")).when(F.col("quantity") == "i", 1 / F.col("_s")).otherwise(1.0)
            own = own.withColumn("_by", by).withColumn("values", F.transform("values", lambda x: (x * F.col("_by")).cast("float"))).drop("scale", "_s", "_by")
        signals.append(own.join(ids.drop("dataset"), "channel_id").withColumn("channel_id", F.col("_new")).drop("_new"))
        acts.append(labels.relabelled(s.activations.join(ids, "channel_id"), "appliance", taxonomy, rename, "dataset").withColumn("channel_id", F.col("_new")).select("channel_id", "appliance", "on", "off"))
        names.append(labels.relabelled(s.appliance_table.withColumn("dataset", F.lit(None).cast("string")), "appliance", taxonomy, rename).drop("dataset").withColumn("_n", F.lit(n)))
    union = lambda x: reduce(lambda a, b: a.unionByName(b), x)
    table = union(names).groupBy("appliance").agg(*(F.max_by(c, "_n").alias(c) for c in ("on_threshold_w", "category", "is_known")))
    out = ST.write_store(path, union(tables), union(signals), union(acts), table, "merge", overwrite)
    out.write_manifest({"source": "merge", "merged_from": [s.path for s in sources], "merge_rules": {"rename": rename or {}, "normalize_voltage": normalize_voltage}})
    return out
