"""A pipeline is a list of (name, params); applying it folds the steps over a lazy DataFrame, so Catalyst sees one plan."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import calendar, indicators, lags, regime, returns, rolling, targets

#: Step name -> operator. Steps with the same name as the class of a step in a stored pipeline load under it.
OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "RSI": indicators.rsi,
    "MACD": indicators.macd,
    "BollingerBands": indicators.bollinger,
    "ATR": indicators.atr,
    "Returns": returns.returns,
    "LogReturns": returns.log_returns,
    "RollingStats": rolling.rolling_stats,
    "Lags": lags.lags,
    "Calendar": calendar.calendar_features,
    "ForwardReturns": targets.forward_returns,
    "ClassifyReturns": targets.classify_returns,
    "TripleBarrier": targets.triple_barrier_labels,
    "VolAdjustedLabels": targets.volatility_adjusted_labels,
    "RollingSkewness": rolling.rolling_skewness,
    "RollingKurtosis": rolling.rolling_kurtosis,
    "TailRatio": rolling.tail_ratio,
    "ZscoreReturns": rolling.zscore_returns,
    "VolatilityRegime": regime.volatility_regime,
    "TrendStrength": regime.trend_strength,
    "MarketState": regime.market_state,
    "BreakoutDetection": regime.breakout_detection,
    "RollingJarqueBera": rolling.rolling_jarque_bera,
}


class FeatureStep:
    """A named operator with its parameters. Subclasses may override ``transform``."""

    name = ""

    def __init__(self, **params: Any):
        self.name = self.name or type(self).__name__
        self.params = params
        if type(self).transform is FeatureStep.transform:
            if self.name not in OPERATORS:
                raise ValueError(f"unknown step {self.name!r}")
            known = list(inspect.signature(OPERATORS[self.name]).parameters)[1:]
            if bad := sorted(set(params) - set(known)):
                raise ValueError(f"{self.name} has no parameters {bad}; it has {known}")

    def transform(self, df: DataFrame) -> DataFrame:
        return OPERATORS[self.name](df, **self.params)

    def to_dict(self) -> dict[str, Any]:
        return {"name": self.name, "params": {k: list(v) if isinstance(v, tuple) else v for k, v in self.params.items()}}

    def __repr__(self) -> str:
        return f"{self.name}({', '.join(f'{k}={v!r}' for k, v in self.params.items())})"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, FeatureStep) and self.to_dict() == other.to_dict()

    __hash__ = None


#: A class for each operator, by the name of the step.
STEPS: dict[str, type[FeatureStep]] = {n: type(n, (FeatureStep,), {"name": n, "__doc__": f.__doc__}) for n, f in OPERATORS.items()}


def step(name: str, **params: Any) -> FeatureStep:
    if name not in STEPS:
        raise ValueError(f"unknown step {name!r}")
    return STEPS[name](**params)


class FeatureSet:
    """An ordered pipeline of steps."""

    def __init__(self, steps: list[FeatureStep] | None = None):
        self.steps = list(steps or [])

    def add(self, step: FeatureStep) -> FeatureSet:
        self.steps.append(step)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, s: d.transform(s.transform), self.steps, df)

    def to_json(self) -> str:
        return json.dumps({"steps": [s.to_dict() for s in self.steps]}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> FeatureSet:
        found = json.loads(text)
        return cls([step(x["name"], **x.get("params", {})) for x in (found["steps"] if isinstance(found, dict) else found)])

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    @classmethod
    def load(cls, path: str) -> FeatureSet:
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read())

    def __len__(self) -> int:
        return len(self.steps)

    def __repr__(self) -> str:
        return f"FeatureSet([{', '.join(map(repr, self.steps))}])"


def save_to(spark: SparkSession, features: FeatureSet, path: str) -> None:
    """Stores a pipeline where Spark can write, as one text row."""
    spark.createDataFrame([(features.to_json().replace("\n", " "),)], "value string").coalesce(1).write.mode("overwrite").text(path)
