"""Split protocols: channels to folds by whole groups (SP-*, AG-02, AG-06)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = "__missing__"


@dataclass
class Split:
    """folds: DataFrame (channel_id, fold); manifest: how it came about."""

    folds: DataFrame
    manifest: dict

    def fold(self, name: str) -> DataFrame:
        return self.folds.where(F.col("fold") == name).select("channel_id")

    def summary(self, channels: DataFrame) -> DataFrame:
        """A row a fold, empty ones too: channels, instances, houses and hours."""
        names = self.folds.sparkSession.createDataFrame([("train",), ("val",), ("test",)], "fold string")
        stats = self.folds.join(channels, "channel_id").groupBy("fold").agg(F.count("*").alias("channels"), F.count_distinct("instance_id").alias("instances"), F.count_distinct("house").alias("houses"), F.sum(F.col("n_samples") / F.col("fs") / 3600).alias("hours"))
        return names.join(stats, "fold", "left").fillna(0)


def check_leakage(folds: DataFrame, channels: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, n_folds): values, and channels, in more than one fold; nulls are no values."""
    joined = folds.join(channels, "channel_id")
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ["channel_id", *keys])))
    return joined.select("fold", pairs.alias("p")).select("fold", "p.*").where("value is not null").groupBy("key", "value").agg(F.count_distinct("fold").alias("n_folds")).where("n_folds > 1")


@dataclass
class SplitProtocol:
    """Sorted groups in the seeded order of numpy's default generator; holdout groups first, then validation, then training.

    The group values come to the driver: they are names of houses, brands or instances.
    """

    test_size: float = 0.2
    holdout_size: float = 0.0
    seed: int = 0
    group_by: str = field(default="instance_id", init=False)

    def __post_init__(self):
        if not 0 < self.test_size < 1:
            raise ValueError(f"test_size must lie between 0 and 1, not {self.test_size}")
        if not 0 <= self.holdout_size < 1:
            raise ValueError(f"holdout_size must be at least 0 and under 1, not {self.holdout_size}")
        if self.test_size + self.holdout_size >= 1:
            raise ValueError("test_size and holdout_size leave nothing to train on")

    def candidates(self, channels: DataFrame) -> DataFrame:
        return channels

    def folds_of(self, groups: list[str]) -> dict[str, str]:
        n = len(groups)
        if n < 2:
            raise ValueError(f"{type(self).__name__} needs two different values of {self.group_by} at least, not {groups}")
        shuffled = np.asarray(groups)[np.random.default_rng(self.seed).permutation(n)].tolist()
        n_test = max(1, round(n * self.holdout_size)) if self.holdout_size else 0
        n_val = min(max(1, round(n * self.test_size)), n - 1 - n_test)
        return {g: "test" if k < n_test else "val" if k < n_test + n_val else "train" for k, g in enumerate(shuffled)}

    def apply(self, channels: DataFrame) -> Split:
        if self.group_by not in channels.columns:
            raise ValueError(f"no column {self.group_by!r}; there are {channels.columns}")
        rows = self.candidates(channels).withColumn("_g", F.coalesce(F.col(self.group_by), F.lit(MISSING)))
        groups = sorted(r[0] for r in rows.select("_g").distinct().collect())
        folds = self.folds_of(groups)
        table = channels.sparkSession.createDataFrame(list(folds.items()), "_g string, fold string")
        by = {f: sorted(g for g, x in folds.items() if x == f) for f in ("train", "val", "test")}
        return Split(rows.join(table, "_g").select("channel_id", "fold"), {"protocol": type(self).__name__, "group_by": self.group_by, "seed": self.seed, "test_size": self.test_size, "holdout_size": self.holdout_size, "n_groups": len(groups), "groups": by})


class RandomSplit(SplitProtocol):
    group_by = "instance_id"

    def __init__(self, test_size=0.2, holdout_size=0.0, seed=0):
        super().__init__(test_size, holdout_size, seed)
        self.group_by = type(self).group_by


class LeaveBrandOut(RandomSplit):
    group_by = "brand"

    def candidates(self, channels):
        return channels.where("brand is not null")


class LeaveHouseOut(RandomSplit):
    group_by = "house"


@dataclass
class CrossDataset:
    train_on: list[str]
    test_on: list[str]

    def apply(self, channels: DataFrame) -> Split:
        if both := sorted(set(self.train_on) & set(self.test_on)):
            raise ValueError(f"trained and tested on: {both}")
        if not self.train_on or not self.test_on:
            raise ValueError("train_on and test_on name a dataset each at least")
        have = {r[0] for r in channels.select("dataset").distinct().collect()}
        if missing := sorted({*self.train_on, *self.test_on} - have):
            raise ValueError(f"datasets not in the store: {missing}")
        fold = F.when(F.col("dataset").isin(self.train_on), "train").when(F.col("dataset").isin(self.test_on), "val")
        return Split(channels.select("channel_id", fold.alias("fold")).where("fold is not null"), {"protocol": "CrossDataset", "train_on": self.train_on, "test_on": self.test_on})


@dataclass
class UnseenAppliance:
    unknown: list[str] | None = None
    n_unknown: int = 1
    seed: int = 0

    def apply(self, channels: DataFrame) -> Split:
        rows = channels.where("appliance is not null")
        classes = sorted(r[0] for r in rows.select("appliance").distinct().collect())
        if self.unknown is not None:
            if missing := sorted(set(self.unknown) - set(classes)):
                raise ValueError(f"appliances not in the store: {missing}")
            held = list(self.unknown)
        else:
            if self.n_unknown >= len(classes):
                raise ValueError(f"cannot hold out {self.n_unknown} of {len(classes)} appliances")
            order = np.random.default_rng(self.seed).permutation(len(classes))
            held = sorted(classes[k] for k in order[: self.n_unknown])
        folds = rows.select("channel_id", F.when(F.col("appliance").isin(held), "val").otherwise("train").alias("fold"))
        return Split(folds, {"protocol": "UnseenAppliance", "group_by": "appliance", "seed": self.seed, "unknown": held, "known": [c for c in classes if c not in held]})
