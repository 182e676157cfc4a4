"""Readers by name; any iterable of recordings is a reader too (SRC-15, UX-01)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from . import binary, synthetic, text

READERS = {"plaid": text.plaid, "ukdale": text.ukdale, "refit": text.refit, "uci": text.uci, "hifda": text.hifda, "whited": binary.whited, "ukdale_waveforms": binary.ukdale_waveforms, "blond": binary.blond, "smartnialm": binary.smartnialm, "fired": binary.fired}


def from_rows(spark: SparkSession, recordings: Iterable[dict]) -> text.Recordings:
    """Recordings from dicts: metadata, and signals {quantity: samples}. For what fits the driver; corpora come through READERS."""
    meta, samples, acts = [], [], []
    for n, r in enumerate(recordings):
        meta.append((n, r["dataset"], r["house"], r.get("session", "run_0"), r["kind"], r.get("appliance"), r.get("brand"), r.get("instance_id"), float(r["fs"]), r.get("f0"), float(r.get("t0", 0.0))))
        samples += [(n, q, k, float(x)) for q, xs in r["signals"].items() for k, x in enumerate(xs)]
        acts += [(n, *a) for a in r.get("activations", ())]
    channels = spark.createDataFrame(meta, "n int, dataset string, house string, session string, kind string, appliance string, brand string, instance_id string, fs double, f0 double, t0 double")
    channels = channels.withColumn("channel_id", F.lit(None).cast("string"))
    from ..plans.store import with_ids

    channels = with_ids(channels.withColumn("n_samples", F.col("n").cast("long"))).drop("n_samples")
    ids = channels.select("n", "channel_id")
    long = spark.createDataFrame(samples, "n int, quantity string, k long, x double").join(ids, "n").drop("n")
    activations = spark.createDataFrame(acts, "n int, appliance string, `on` long, off long").join(ids, "n").drop("n")
    return text.Recordings(channels.drop("n"), long, activations)


def load_results(spark: SparkSession, path: str):
    return spark.read.csv(path, header=True, inferSchema=True)


__all__ = ["READERS", "from_rows", "load_results", "synthetic", "labels"]
