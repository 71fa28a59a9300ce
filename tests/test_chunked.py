import pytest
from pyspark.sql import functions as F

from quantloom.operators import indicators, regime, risk, rolling, targets
from quantloom.plans.chunked import by_chunks, ewm_lookback
from quantloom.sources.bars import bars_orders

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("every", ["month", "year"])
@pytest.mark.parametrize("f,back,ahead", [
    (lambda d: indicators.sma(d, 20), 19, 0), (lambda d: rolling.zscore_returns(d, 30), 30, 0), (lambda d: indicators.rsi(d, 14), ewm_lookback(14) + 1, 0),
    (lambda d: targets.triple_barrier_labels(d, max_holding=10), 0, 10), (lambda d: regime.trend_strength(d, 20), 20, 0), (lambda d: targets.forward_returns(d, 5), 0, 5),
])
def test_chunks_equal_the_whole(spark, f, back, ahead, every):
    bars = bars_orders(spark, SF).filter("symbol < '3'").cache()
    whole, cut = f(bars), by_chunks(bars, f, back, ahead, every)
    assert cut.columns == [*bars.columns, *[c for c in whole.columns if c not in bars.columns]]
    assert rows(cut.select(whole.columns)) == rows(whole)


def test_one_series_is_spread(spark):
    one = bars_orders(spark, SF).withColumn("symbol", F.lit("X")).dropDuplicates(["timestamp"])
    plan = by_chunks(one, lambda d: indicators.sma(d, 5), 4)
    keys = plan.select(F.year("timestamp")).distinct().count()
    assert keys > 3 and plan.count() == one.count()


def test_null_symbols_and_none(spark):
    df = spark.createDataFrame([(None, "2024-01-01", 1.0), (None, "2024-02-01", 3.0), ("A", "2024-02-01", 5.0)], "symbol string, timestamp string, close double").withColumn("timestamp", F.to_date("timestamp"))
    f = lambda d: indicators.sma(d, 2)
    got = {(r.symbol, r.close): r.sma_2 for r in by_chunks(df, f, 1, every="month").collect()}
    assert got == {(None, 1.0): None, (None, 3.0): 2.0, ("A", 5.0): None}
    plain = by_chunks(df.filter("symbol IS NULL").drop("symbol"), f, 1, every="month")
    assert plain.columns == ["timestamp", "close", "sma_2"] and sorted(r.sma_2 or 0 for r in plain.collect()) == [0, 2.0]
    with pytest.raises(ValueError):
        by_chunks(df, f, -1)


def test_rolling_risk_in_chunks(spark):
    bars = bars_orders(spark, SF).filter("symbol < '2'").cache()
    f = lambda d: risk.value_at_risk(d, window=20).filter("var_20 IS NOT NULL")
    assert rows(by_chunks(bars, f, 21).select("timestamp", "var_20"))[25:] == rows(f(bars).select("timestamp", "var_20"))[25:]
