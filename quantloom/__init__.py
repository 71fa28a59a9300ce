"""Market-bar analytics on Spark DataFrames. Names are imported when they are first used."""

import importlib

__version__ = "0.1.0"

_MODULES = ("agents", "features", "plans", "portfolio", "profiler", "quality", "sources", "stats", "streaming")
_NAMES = {"load": "sources", "cache_clear": "sources", "set_fetcher": "sources", "config": "config", "FeatureSet": "plans"}


def __getattr__(name: str):
    if name in _MODULES:
        return importlib.import_module(f".{name}", __name__)
    if name in _NAMES:
        return getattr(importlib.import_module(f".{_NAMES[name]}", __name__), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")


def __dir__() -> list[str]:
    return sorted([*globals(), *_MODULES, *_NAMES])
