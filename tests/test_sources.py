import datetime as dt
import json

import pandas as pd
import pytest

from quantloom import sources
from quantloom.config import config
from quantloom.sources import bars as bar_builders, schema
from quantloom.sources.cache import cache_get, cache_put


@pytest.fixture
def cache(tmp_path, monkeypatch):
    monkeypatch.setattr(config, "cache_dir", f"{tmp_path}/cache")
    yield tmp_path
    sources.set_fetcher(None)


def frame(n=5, start="2024-01-01"):
    days = pd.date_range(start, periods=n)
    return pd.DataFrame({"Date": days, "Open": 1.0, "High": 2.0, "Low": 0.5, "Close": [1.0 + i for i in range(n)], "Volume": 10, "Dividends": 0.0})


def test_names_and_types(spark):
    df = spark.createDataFrame([("2024-01-02", "1.5", "x", "3")], "Date string, Close string, `Adj Close` string, `Some Thing` string")
    out = schema.cast_ohlcv_types(schema.standardize_columns(df))
    assert out.columns == ["timestamp", "close", "adj_close", "some_thing"]
    assert out.first().asDict() == {"timestamp": dt.date(2024, 1, 2), "close": 1.5, "adj_close": "x", "some_thing": "3"}
    assert schema.standardize_columns(df.select("Date", "Adj Close")).columns == ["timestamp", "close"]
    times = schema.cast_ohlcv_types(spark.createDataFrame([("2024-01-02 10:00:00", "nan")], "timestamp string, close string"))
    assert times.first().timestamp == dt.datetime(2024, 1, 2, 10) and times.first().close is None
    left = schema.cast_ohlcv_types(spark.createDataFrame([("soon", 1.0)], "timestamp string, close double"))
    assert left.first().timestamp == "soon"
    with pytest.raises(ValueError):
        schema.validate_ohlcv(df)


def test_paths():
    assert all(map(sources.is_file_path, ("a/b", "x.csv", "x.PQ", "c:\\x")))
    assert not any(map(sources.is_file_path, ("AAPL", "BRK.B")))


@pytest.mark.parametrize("kind", ["csv", "parquet", "pq", "json"])
def test_files(spark, tmp_path, kind):
    p = frame()[["Date", "Close", "Volume"]]
    path = f"{tmp_path}/x.{kind}"
    if kind == "csv":
        p.to_csv(path, index=False)
    elif kind == "json":
        with open(path, "w") as f:
            json.dump(json.loads(p.assign(Date=p.Date.dt.strftime("%Y-%m-%d")).to_json(orient="records")), f)
    else:
        p.assign(Date=p.Date.dt.date).to_parquet(path, index=False)
    df = sources.load(spark, path, start="2024-01-02", end="2024-01-04")
    assert set(df.columns) == {"timestamp", "close", "volume"} and df.count() == 3 and dict(df.dtypes)["volume"] == "double"
    assert len(sources.load(spark, path, backend="pandas")) == 5


def test_range_reaches_the_scan(spark, tmp_path):
    frame().assign(Date=lambda d: d.Date.dt.date).rename(columns={"Date": "timestamp", "Close": "close"}).to_parquet(f"{tmp_path}/x.parquet", index=False)
    plan = sources.load(spark, f"{tmp_path}/x.parquet", start="2024-01-03").select("close")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp,2024-01-03)]" in plan and "Open" not in plan.split("ReadSchema")[1]


def test_bad_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sources.load(spark, f"{tmp_path}/none.csv")
    (tmp_path / "x.xls").write_text("a")
    with pytest.raises(ValueError):
        sources.load(spark, f"{tmp_path}/x.xls")
    with pytest.raises(ValueError):
        sources.load(spark, "A", backend="other")


def test_tickers_and_cache(spark, cache):
    calls = []

    def fetch(symbol, start, end, interval):
        calls.append((symbol, interval))
        return frame() if symbol != "NONE" else frame(0)

    sources.set_fetcher(fetch)
    df = sources.load(spark, "abc", start="2024-01-01", end="2024-01-05")
    assert df.columns == ["timestamp", "open", "high", "low", "close", "volume", "symbol"] and df.first().symbol == "ABC" and isinstance(df.first().timestamp, dt.date)
    again = sources.load(spark, "ABC", start="2024-01-02", end="2024-01-04")
    assert len(calls) == 1 and again.count() == 3
    sources.load(spark, "ABC", start="2024-01-01", end="2024-02-01")
    assert len(calls) == 2  # the range wasn't covered
    sources.load(spark, "ABC", start="2024-01-01", end="2024-01-05", interval="1h")
    assert calls[-1] == ("ABC", "1h")
    both = sources.load(spark, ["ABC", "NONE", "XYZ"], start="2024-01-01", end="2024-01-05", use_cache=False)
    assert both.count() == 10 and {r.symbol for r in both.collect()} == {"ABC", "XYZ"}
    with pytest.raises(ValueError):
        sources.load(spark, ["NONE"])
    sources.cache_clear(spark, "abc")
    assert cache_get(spark, "ABC", "2024-01-01", "2024-01-05") is None


def test_a_failed_write_keeps_the_entry(spark, cache):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0)], "timestamp date, close double")
    cache_put(spark, "A", df, "2024-01-01", "2024-01-01")
    cache_put(spark, "A", df.selectExpr("timestamp", "raise_error('no') AS close"), "2024-01-01", "2024-01-01")
    assert cache_get(spark, "A", "2024-01-01", "2024-01-01").count() == 1
    sources.cache_clear(spark)
    assert cache_get(spark, "A") is None


def test_a_folder_that_cannot_be_made_is_replaced(spark, tmp_path, monkeypatch):
    (tmp_path / "file").write_text("in the way")
    monkeypatch.setattr(config, "cache_dir", f"{tmp_path}/file/cache")
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path / "other"))
    cache_put(spark, "A", spark.createDataFrame([(dt.date(2024, 1, 1), 1.0)], "timestamp date, close double"), "2024-01-01", "2024-01-01")
    assert config.cache_dir == f"{tmp_path}/other/quantloom-cache" and cache_get(spark, "A", "2024-01-01", "2024-01-01").count() == 1


def test_no_fetcher(spark, cache):
    with pytest.raises((ImportError, ValueError)):
        sources.load(spark, "ABC", use_cache=False)


def test_bars(spark):
    b = bar_builders.bars_orders(spark, "/root/testdata/sf0.001")
    assert b.count() == b.select("symbol", "timestamp").distinct().count() == 1402
    assert b.filter("low > open OR low > close OR high < open OR high < close").count() == 0


def test_load_query_gives_the_whole_file(spark):
    from quantloom import queries as q

    sf = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{sf}/orders.parquet")
    got = q.QUERIES["load_parquet"](spark, sf)
    assert got.columns == want.columns and got.count() == want.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
