import pandas as pd
import pytest

import quantloom
from quantloom.sources.datasource import register


def test_namespaces(bars):
    assert set(dir(quantloom.features)) >= {"rsi", "add_all", "FeatureSet", "RSI", "MarketState"}
    assert len([n for n in quantloom.features.__all__ if n[0].islower()]) == 41
    assert quantloom.load is quantloom.sources.load and quantloom.FeatureSet is quantloom.features.FeatureSet
    assert quantloom.features.RSI(period=5).transform(bars).columns[-1] == "rsi_5"
    for module in ("stats", "portfolio", "quality", "profiler", "agents", "streaming", "plans"):
        m = getattr(quantloom, module)
        assert all(hasattr(m, n) for n in m.__all__)
    with pytest.raises(AttributeError):
        quantloom.nothing
    assert "load" in dir(quantloom)


def test_tickers_in_parallel(spark):
    def fetch(symbol, start, end, interval):
        if symbol == "none":
            return pd.DataFrame()
        return pd.DataFrame({"Date": pd.date_range(start, periods=3), "Close": [1.0, "x", 3.0], "Adj Close": 9.0})

    register(spark, fetch)
    df = spark.read.format("tickers").option("symbols", "aa, none,bb").option("start", "2024-01-01").load()
    assert df.rdd.getNumPartitions() == 3
    rows = df.orderBy("symbol", "timestamp").collect()
    assert [(r.symbol, r.close, r.open) for r in rows] == [(s, c, None) for s in ("AA", "BB") for c in (1.0, None, 3.0)]
    with pytest.raises(Exception, match="symbols"):
        spark.read.format("tickers").load().count()
