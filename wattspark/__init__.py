"""A PySpark engine for electricity-load series; names load when they are used."""

from __future__ import annotations

import importlib

_WHERE = {
    "Store": "plans.store", "write_store": "plans.store", "Measurement": "plans.measurement", "HighFreqView": "plans.views", "LowFreqView": "plans.views",
    "compatibility": "plans.compat", "merge_stores": "plans.compat", "Taxonomy": "functions.labels", "READERS": "sources.registry", "from_rows": "sources.registry",
    "RandomSplit": "operators.splits", "LeaveBrandOut": "operators.splits", "LeaveHouseOut": "operators.splits", "CrossDataset": "operators.splits", "UnseenAppliance": "operators.splits",
    "Evaluator": "operators.metrics", "ZScore": "operators.detect", "Cusum": "operators.detect", "Glr": "operators.detect", "GoodnessOfFit": "operators.detect",
    "AdaptiveThreshold": "operators.detect", "Multivariate": "operators.detect", "ActiveSections": "operators.detect", "match_events": "operators.match", "event_counts": "operators.match", "predict": "plans.inference",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(importlib.import_module(f".{_WHERE[name]}", __name__), name)
    raise AttributeError(name)


def __dir__():
    return __all__
