import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions.windows import ewm
from quantloom.operators import features, indicators as ind
from quantloom.operators.lags import validate_no_lookahead


def close(df, bars, symbol="AAA"):
    p = bars.filter(F.col("symbol") == symbol).toPandas().sort_values("timestamp").reset_index(drop=True)
    o = df.filter(F.col("symbol") == symbol).toPandas().sort_values("timestamp").reset_index(drop=True)
    return p, o


def same(got, want, rel=1e-9):
    got, want = np.array(got, float), np.array(want, float)
    assert (np.isnan(got) == np.isnan(want)).all()
    np.testing.assert_allclose(got[~np.isnan(got)], want[~np.isnan(want)], rtol=rel, atol=1e-9)


@pytest.mark.parametrize("span", [1, 2, 5, 20, 200])
def test_ewm_equals_the_recursion(bars, span):
    p, o = close(ewm(bars, {"y": ("close", span)}), bars)
    same(o.y, p.close.ewm(span=span, adjust=False).mean())


def test_ewm_over_many_blocks(spark):
    n = 3000
    x = np.random.default_rng(3).normal(100, 5, n)
    df = spark.createDataFrame([("S", i, float(x[i])) for i in range(n)], "symbol string, timestamp int, close double")
    same([r.y for r in ewm(df, {"y": ("close", 3)}).orderBy("timestamp").collect()], pd.Series(x).ewm(span=3, adjust=False).mean())


def test_ewm_skips_nulls(closes, column):
    x = [None, 1.0, None, 3.0, 2.0, None, 5.0]
    same([np.nan if v is None else v for v in column(ewm(closes(x), {"y": ("close", 3)}), "y")], pd.Series(x, dtype=float).ewm(span=3, adjust=False, ignore_na=True).mean().where(pd.Series(x, dtype=float).notna()))


def test_sma_by_hand(closes, column):
    assert column(ind.sma(closes([100.0, 102.0, 101.0, 103.0]), 3), "sma_3") == [None, None, 101.0, 102.0]


def test_rsi(bars):
    p, o = close(ind.rsi(bars), bars)
    d = p.close.diff()
    g, l = d.clip(lower=0)[1:].ewm(span=14, adjust=False).mean(), (-d).clip(lower=0)[1:].ewm(span=14, adjust=False).mean()
    same(o.rsi_14[1:], 100 - 100 / (1 + g / l))
    assert np.isnan(o.rsi_14[0])


def test_rsi_limits(closes, column):
    assert column(ind.rsi(closes([1.0, 2.0, 3.0]), 2), "rsi_2") == [None, 100.0, 100.0]
    assert column(ind.rsi(closes([3.0, 2.0, 1.0]), 2), "rsi_2") == [None, 0.0, 0.0]
    assert column(ind.rsi(closes([3.0, 3.0]), 2), "rsi_2") == [None, None]


def test_macd(bars):
    p, o = close(ind.macd(bars), bars)
    line = p.close.ewm(span=12, adjust=False).mean() - p.close.ewm(span=26, adjust=False).mean()
    same(o.macd_line, line)
    same(o.macd_signal, line.ewm(span=9, adjust=False).mean(), 1e-7)
    same(o.macd_hist, o.macd_line - o.macd_signal)


def test_bollinger_bounds(bars):
    _, o = close(ind.bollinger(bars), bars)
    assert (o.bb_lower.dropna() <= o.bb_upper.dropna()).all() and o.bb_middle.isna().sum() == 19


def test_atr_and_adx(bars):
    p, o = close(ind.adx(ind.atr(bars)), bars)
    prev = p.close.shift()
    tr = pd.concat([p.high - p.low, (p.high - prev).abs(), (p.low - prev).abs()], axis=1).max(axis=1)
    same(o.atr_14, tr.ewm(span=14, adjust=False).mean())
    up, down = p.high.diff(), -p.low.diff()
    plus = np.where(up > down, up.clip(lower=0), 0)
    minus = np.where(down > up, down.clip(lower=0), 0)
    e = lambda x: pd.Series(x).ewm(span=14, adjust=False).mean()
    pdi, mdi = e(plus) / e(tr) * 100, e(minus) / e(tr) * 100
    same(o.plus_di, pdi)
    dx = ((pdi - mdi).abs() / (pdi + mdi) * 100)
    same(o.adx_14, dx.ewm(span=14, adjust=False, ignore_na=True).mean().where(dx.notna()))
    assert o.adx_14.notna().sum() > 100


def test_vwap_obv_stochastic_williams_mfi_cci(bars):
    df = ind.cci(ind.mfi(ind.williams_r(ind.stochastic(ind.obv(ind.vwap(bars))))))
    p, o = close(df, bars)
    tp = (p.high + p.low + p.close) / 3
    same(o.vwap, (tp * p.volume).cumsum() / p.volume.cumsum())
    same(o.obv, (np.sign(p.close.diff()).fillna(0) * p.volume).cumsum())
    lo, hi = p.low.rolling(14).min(), p.high.rolling(14).max()
    k = (p.close - lo) / (hi - lo) * 100
    same(o.stoch_k, k)
    same(o.stoch_d, k.rolling(3).mean())
    same(o.williams_r_14, (hi - p.close) / (hi - lo) * -100)
    flow, step = tp * p.volume, tp.diff()
    pos, neg = flow.where(step > 0, 0).rolling(14).sum(), flow.where(step < 0, 0).rolling(14).sum()
    same(o.mfi_14, 100 - 100 / (1 + pos / neg), 1e-7)
    same(o.cci_20, (tp - tp.rolling(20).mean()) / (0.015 * tp.rolling(20).std()), 1e-7)


def test_roc_momentum(closes, column):
    df = ind.momentum(ind.roc(closes([1.0, 2.0, 0.0, 4.0]), 1), 2)
    assert column(df, "roc_1") == [None, 100.0, -100.0, None]
    assert column(df, "momentum_2") == [None, None, -1.0, 2.0]


def test_no_symbol_column(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "timestamp int, close double")
    assert [r.ema_3 for r in ind.ema(ind.sma(df, 2), 3).orderBy("timestamp").collect()] == pytest.approx(pd.Series(range(1, 6)).ewm(span=3, adjust=False).mean().tolist())


def test_flat_and_zero_prices_give_null(closes, column):
    flat = closes([5.0] * 30, high=[5.0] * 30, low=[5.0] * 30, volume=[0.0] * 30)
    df = ind.vwap(ind.stochastic(flat))
    assert set(column(df, "stoch_k")) == {None} and set(column(df, "vwap")) == {None}
    assert column(ind.roc(closes([0.0, 1.0]), 1), "roc_1") == [None, None]


@pytest.mark.parametrize("f", [ind.sma, ind.bollinger, ind.williams_r, ind.mfi, ind.roc])
def test_bad_periods(bars, f):
    with pytest.raises(ValueError):
        f(bars, 0)


def test_rows_and_no_lookahead(bars):
    part = bars.filter(F.col("timestamp") < dt.date(2024, 3, 15))
    whole, half = features.add_all(bars), features.add_all(part)
    assert whole.count() == bars.count()
    names = [c for c in whole.columns if c not in bars.columns]
    assert validate_no_lookahead(whole, half, names, 1e-8)


def test_one_exchange_for_all_features(bars):
    plan = features.add_all(bars, lags_=[1, 2], rolling_windows=[5, 21], calendar=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1


def test_single_symbol_is_a_slice(bars):
    one = features.add_all(bars.filter("symbol = 'BBB'")).orderBy("timestamp").toPandas()
    both = features.add_all(bars).filter("symbol = 'BBB'").orderBy("timestamp").toPandas()
    pd.testing.assert_frame_equal(one, both)


def test_means_of_a_call_share_sorts(spark):
    """Sorts of plans from unsorted bars; each mean of its own blocks would add one and another one back."""
    from quantloom import queries as q
    from quantloom.operators import indicators as i

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        b = q.bars_orders(spark, "/root/testdata/sf0.001")
        sorts = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Sort [")
        assert sorts(i.ema(b)) == 3 and sorts(i.rsi(b)) == 3 and sorts(i.macd(b)) <= 5 and sorts(i.adx(b)) <= 7
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


@pytest.mark.parametrize("spans", [(12, 26), (2, 300), (5, 5)])
def test_shared_blocks_change_no_mean(spark, bars, spans):
    """Two means of one input, with and without shared ranks and blocks, also where the spans are too far apart to share."""
    from quantloom.functions.windows import ewm

    given = bars.withColumn("close", F.when(F.col("timestamp") < "2024-01-06", None).otherwise(F.col("close")))
    rows = lambda alike: ewm(given, {"a": ("close", spans[0]), "b": ("close", spans[1])}, alike).orderBy("symbol", "timestamp").select("a", "b").collect()
    for x, y in zip(rows([("a", "b")]), rows([])):
        for u, v in zip(x, y):
            assert u == v or abs(u - v) < 1e-9 * abs(v)
