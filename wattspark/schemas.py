"""Canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T

FORMAT_VERSION = 1
KINDS = ("mains", "submeter")
QUANTITIES = ("v", "i", "p")
DEFAULT_ON_THRESHOLD_W = 10.0
CHUNK = 65_536


def _struct(**fields) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType(), "b": T.BooleanType(), "i": T.IntegerType(), "as": T.ArrayType(T.StringType()), "af": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(k, kinds[v]) for k, v in fields.items()])


CHANNELS = _struct(channel_id="s", dataset="s", house="s", session="s", kind="s", appliance="s", brand="s", instance_id="s", fs="d", f0="d", t0="d", n_samples="l", quantities="as", sha256="s")
ACTIVATIONS = _struct(channel_id="s", appliance="s", on="l", off="l")
APPLIANCES = _struct(appliance="s", on_threshold_w="d", category="s", is_known="b")
SIGNALS = _struct(channel_id="s", quantity="s", chunk="l", start="l", values="af")
#: What readers give: metadata of a channel, and one row a chunk of samples.
RECORDINGS = _struct(dataset="s", house="s", session="s", kind="s", appliance="s", brand="s", instance_id="s", fs="d", f0="d", t0="d")
