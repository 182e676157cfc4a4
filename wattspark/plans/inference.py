"""Batch inference: a registry of callables on arrays of windows, run over Arrow batches (MD-*, UX-*)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MODELS: dict[str, Callable[..., Callable[[np.ndarray], np.ndarray]]] = {}


def register(name: str):
    def add(make):
        MODELS[name] = make
        return make

    return add


@register("mean_share")
def mean_share(n_appliances: int, shares: list[float] | None = None):
    """Each appliance takes a fixed share of the aggregate: the baseline that a trained model has to beat."""
    s = np.asarray(shares or [1 / n_appliances] * n_appliances)
    return lambda x: np.maximum(x[:, None, :] * s[None, :, None], 0.0)


@register("seq2point")
def seq2point(n_appliances: int, length: int = 99, seed: int = 0):
    """A one-layer convolution with seeded weights: windows (B, L) to (B, K, 1), not negative."""
    w = np.random.default_rng(seed).normal(0, 1 / np.sqrt(length), (n_appliances, length))
    return lambda x: np.maximum(np.einsum("bl,kl->bk", x[:, :length], w[:, : x.shape[1]]), 0.0)[:, :, None]


def build(name: str, n_appliances: int, **kw):
    if name not in MODELS:
        raise KeyError(f"unknown model {name!r}; there are {sorted(MODELS)}")
    return MODELS[name](n_appliances, **kw)


def predict(windows: DataFrame, model: Callable[[np.ndarray], np.ndarray], aggregate: str, keys: list[str], scale: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """keys and prediction (appliances x steps) of each window's standardised aggregate."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = (np.stack(pdf[aggregate].map(np.asarray)).astype(float) - scale[0]) / max(scale[1], 1e-12)
                yield pd.concat([pdf[keys], pd.DataFrame({"prediction": [y.tolist() for y in model(x)]})], axis=1)

    fields = {f.name: f.dataType.simpleString() for f in windows.schema}
    return windows.select(*keys, aggregate).mapInPandas(run, ", ".join([f"`{k}` {fields[k]}" for k in keys] + ["prediction array<array<double>>"]))
