import datetime as dt
import json
import os

import pytest

from quantloom import agents
from quantloom.agents.tools import ALLOWED, execute_tool, langchain_tools
from quantloom.operators import features
from quantloom.plans import STEPS, FeatureSet, FeatureStep, step
from quantloom.plans.pipeline import save_to
from quantloom.streaming import event_bars, feature_batches


def test_pipeline_round_trip(bars, tmp_path):
    made = FeatureSet([step("RSI", period=7)]).add(step("Returns", periods=[1, 2])).add(step("ClassifyReturns", thresholds=(-0.02, 0.02)))
    made.save(f"{tmp_path}/p.json")
    back = FeatureSet.load(f"{tmp_path}/p.json")
    assert len(back) == 3 and repr(back) == repr(made).replace("(-0.02, 0.02)", "[-0.02, 0.02]")
    a, b = (x.transform(bars).orderBy("symbol", "timestamp").collect() for x in (made, back))
    assert a == b and "rsi_7" in a[0]


def test_every_step_runs(bars):
    assert len(STEPS) == 22
    for name in STEPS:
        params = {"columns": "close", "lags": [1]} if name == "Lags" else {}
        assert step(name, **params).transform(bars).count() == 240, name


def test_bad_and_own_steps(bars, spark, tmp_path):
    with pytest.raises(ValueError):
        step("Nothing")
    with pytest.raises(ValueError):
        step("RSI", days=3)
    with pytest.raises(ValueError):
        FeatureSet.from_json('{"steps": [{"name": "Nothing", "params": {}}]}')

    class Twice(FeatureStep):
        def transform(self, df):
            return df.withColumn("twice", df["close"] * self.params["by"])

    assert "twice" in FeatureSet([Twice(by=2)]).transform(bars).columns
    save_to(spark, FeatureSet([step("MACD")]), f"file://{tmp_path}/stored")
    assert len(FeatureSet.from_json(spark.read.text(f"file://{tmp_path}/stored").first().value)) == 1


def test_summary(bars):
    one = bars.filter("symbol = 'AAA'")
    text = agents.summarize(features.add_all(one), include_profile=True)
    p = one.toPandas().sort_values("timestamp").close.to_numpy()
    for part in ("AAA: 120 rows from 2024-01-01 to 2024-04-29", f"close {p[-1]:.2f}, between {p.min():.2f} and {p.max():.2f}", f"{p[-1] / p[-2] - 1:+.2%} over 1", f"{p[-1] / p[-6] - 1:+.2%} over 5", f"{p[-1] / p[-22] - 1:+.2%} over 21", "rsi_14", "sma_50", "its signal", "of its mean", "profile of 120 rows"):
        assert part in text
    assert agents.summarize(one, max_tokens=5).endswith("...") and len(agents.summarize(one, max_tokens=5)) == 23


def test_context(bars):
    one = features.add_all(bars.filter("symbol = 'AAA'"))
    assert agents.context(one, "latest volume").splitlines()[0] == "| timestamp | symbol | close | volume | vwap | obv |"
    assert len(agents.context(one, "latest volume", 5000).splitlines()) == 12
    rows = json.loads(agents.context(one, "is the rsi overbought", format="json"))
    assert len(rows) == 20 and set(rows[0]) == {"timestamp", "symbol", "close", "rsi_14"} and rows[-1]["timestamp"] == "2024-04-29"
    assert "more rows)" in agents.context(one, "entire history", 60) and len(agents.context(one, "the history", format="text").splitlines()) == 121
    assert len(agents.context(one, "a small fall", format="text").splitlines()) == 21  # no word of its own for everything
    assert agents.context(one.select("timestamp", "close", "volume"), "anything", format="text").startswith("timestamp\tclose\tvolume")


def test_schema(bars):
    text = agents.schema(features.add_all(bars))
    assert "240 rows" in text and "2 symbols: AAA, BBB" in text and "- rsi_14: double, " in text and " null (" in text


def test_tools(spark, bars):
    specs = agents.tools(["AAA"])
    assert len(specs) == 9 and all("AAA" in s["function"]["description"] for s in specs)

    def load(spark, source, start=None, end=None):
        return bars.filter(bars["symbol"].isin(source if isinstance(source, list) else [source]))

    run = lambda name, **a: execute_tool(spark, name, a, load)
    assert len(run("lookup_price", symbol="AAA").splitlines()) == 11
    assert "bb_upper" in run("get_technical_indicators", symbol="AAA", indicators=["bollinger", "__import__"])
    for metric, word in (("returns", "returns"), ("sharpe", "sharpe"), ("volatility", "volatility"), ("drawdown", "drawdown")):
        assert word in run("compare_symbols", symbols=["AAA", "BBB"], metric=metric)
    assert run("compare_symbols", symbols=["ZZZ"]).startswith("none of")
    assert "AAA: 50 rows" in run("get_summary", symbol="AAA", days=50)
    assert "undercut on 10% of days" in run("assess_risk", symbol="AAA", confidence=0.9)
    assert "correlation of AAA and BBB" in run("portfolio_analysis", symbols=["AAA", "BBB"], weights={"AAA": 1, "BBB": 1})
    rows = json.loads(run("screen_stocks", symbols=["AAA", "BBB"]))
    assert [r["symbol"] for r in rows] == ["AAA", "BBB"] and json.loads(run("screen_stocks", symbols=["AAA", "BBB"], min_sharpe=99)) == []
    assert json.loads(run("data_quality_check", symbol="AAA"))["rows"] == 120
    assert run("profile_stock", symbol="AAA").startswith("profile of 120 rows")
    assert "other" in run("other") and "rsi" in ALLOWED
    try:
        import langchain_core  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            langchain_tools(spark)


def test_langchain_tools_with_a_stub(spark, bars, monkeypatch):
    """The library is replaced by a stub that keeps what it is given."""
    import sys
    import types

    class StructuredTool:
        @classmethod
        def from_function(cls, **kept):
            return types.SimpleNamespace(**kept)

    stub = types.ModuleType("langchain_core.tools")
    stub.StructuredTool = StructuredTool
    monkeypatch.setitem(sys.modules, "langchain_core", types.ModuleType("langchain_core"))
    monkeypatch.setitem(sys.modules, "langchain_core.tools", stub)
    made = {t.name: t for t in langchain_tools(spark, ["AAA"], lambda spark, source, start=None, end=None: bars.filter(bars["symbol"] == source))}
    assert len(made) == 8 and "compare_symbols" not in made and made["lookup_price"].args_schema["required"] == ["symbol"]
    assert len(made["lookup_price"].func(symbol="AAA").splitlines()) == 11 and "Known symbols: AAA" in made["profile_stock"].description


def test_streamed_bars(spark, tmp_path):
    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    parts = [[("a", t(0, 5), 1.0), ("a", t(0, 50), 3.0), ("b", t(0, 10), 7.0)], [("a", t(1, 1), 2.0), ("a", t(5, 0), 9.0)], [("a", t(5, 30), 9.0)], [("a", t(0, 20), 100.0), ("b", t(9, 0), 1.0)], [("a", t(12, 0), 1.0)]]
    schema = "event_type string, ts timestamp, value double"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{i}")
    for i in range(len(parts)):  # files are taken in the order of their times
        for f in (tmp_path / "in" / str(i)).glob("part-*"):
            os.utime(f, (1_700_000_000 + 100 * i,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"file://{tmp_path}/in/*")
    q = feature_batches(event_bars(stream), f"file://{tmp_path}/bars", f"file://{tmp_path}/cp", lambda d: features.add_all(d)).trigger(availableNow=True).start()
    q.awaitTermination()
    stored = {(r.symbol, r.timestamp.hour): (r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(f"file://{tmp_path}/bars").collect()}
    assert stored[("a", 0)] == (1.0, 3.0, 1.0, 3.0, 2.0) and stored[("b", 0)][4] == 1.0 and ("a", 12) not in stored
    made = spark.read.parquet(f"file://{tmp_path}/bars-features")
    assert made.count() == len(stored) and "rsi_14" in made.columns


def test_streamed_features_read_a_bounded_history(spark, tmp_path):
    """One bar a day; with a look-back of two days a batch sees three bars at most, without one it sees all that are stored."""
    schema = "event_type string, ts timestamp, value double"
    for i in range(6):
        spark.createDataFrame([("a", dt.datetime(2024, 1, 1 + i, 12), float(i))], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        for f in (tmp_path / "in" / str(i)).glob("part-*"):
            os.utime(f, (1_700_000_000 + 100 * i,) * 2)
    seen = {}
    for days in (2, None):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
        at = f"file://{tmp_path}/{days}"
        count = lambda d: d.join(d.groupBy("symbol").count(), "symbol")
        feature_batches(event_bars(stream), f"{at}/bars", f"{at}/cp", count, history_days=days).trigger(availableNow=True).start().awaitTermination()
        seen[days] = [r["count"] for r in spark.read.parquet(f"{at}/bars-features").orderBy("timestamp").collect()]
    assert seen[2] == [min(k, 3) for k in range(1, len(seen[2]) + 1)] and seen[None] == list(range(1, len(seen[2]) + 1)) and len(seen[2]) >= 4
    with pytest.raises(ValueError):
        feature_batches(event_bars(stream), "x", "y", count, history_days=-1)
