import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import calendar, cross, lags, regime, returns, rolling, targets

from .test_indicators import close, same


def test_returns(closes, column):
    df = returns.log_returns(returns.returns(closes([100.0, 110.0, 0.0, 50.0]), [1, 2]), 1)
    assert column(df, "returns_1d") == [None, pytest.approx(0.1), -1.0, None]
    assert column(df, "returns_2d")[2:] == [-1.0, pytest.approx(50 / 110 - 1)]
    assert column(df, "log_returns_1d") == [None, pytest.approx(math.log(1.1)), None, None]


def test_drawdown(closes, column):
    df = returns.drawdown(returns.cumulative_returns(closes([100.0, 120.0, 90.0, 130.0])))
    assert column(df, "drawdown") == [0.0, 0.0, -0.25, 0.0]
    assert column(df, "max_drawdown") == [0.0, 0.0, -0.25, -0.25]
    assert column(df, "cumulative_returns") == [0.0, pytest.approx(0.2), pytest.approx(-0.1), pytest.approx(0.3)]


def _skew(x):
    x = np.asarray(x, float)
    m = x - x.mean()
    return (m**3).mean() / (m**2).mean() ** 1.5


def _kurt(x):
    x = np.asarray(x, float)
    m = x - x.mean()
    return (m**4).mean() / (m**2).mean() ** 2 - 3


def test_rolling_stats(bars):
    p, o = close(rolling.rolling_stats(bars, [5, 21], stats=["mean", "std", "min", "max", "skew", "zscore"]), bars)
    w = p.close.rolling(21)
    same(o.rolling_mean_21, w.mean())
    same(o.rolling_std_21, w.std())
    same(o.rolling_skew_21, w.apply(_skew), 1e-6)
    same(o.rolling_zscore_21, (p.close - w.mean()) / w.std(), 1e-7)
    with pytest.raises(ValueError):
        rolling.rolling_stats(bars, 5, stats=["median"])


def test_distributions(bars):
    df = rolling.zscore_returns(rolling.rolling_jarque_bera(rolling.tail_ratio(rolling.rolling_kurtosis(rolling.rolling_skewness(bars)))))
    p, o = close(df, bars)
    ret = p.close.pct_change()
    same(o.rolling_skew_63, ret.rolling(63).apply(_skew), 1e-6)
    want = pd.Series([_kurt(ret[max(0, i - 62) : i + 1].dropna()) if i >= 62 else np.nan for i in range(len(ret))])
    same(o.rolling_kurtosis_63, want, 1e-6)
    tails = pd.Series([abs(np.quantile(x, 0.95) / np.quantile(x, 0.05)) if i >= 62 else np.nan for i in range(len(ret)) for x in [ret[max(0, i - 62) : i + 1].dropna()]])
    same(o.tail_ratio_63, tails)
    assert (o.rolling_jb_63.dropna() >= 0).all() and o.rolling_jb_63.notna().sum() == len(p) - 62
    same(o.zscore_returns_63, (ret - ret.rolling(63).mean()) / ret.rolling(63).std(), 1e-7)


def test_kurtosis_of_constant_prices_is_zero(closes, column):
    assert column(rolling.rolling_kurtosis(closes([5.0] * 8), 6), "rolling_kurtosis_6")[-1] == 0.0


def test_lags(bars, closes, column):
    assert column(lags.lags(closes([1.0, 2.0, 3.0]), "close", [1, 2]), "close_lag_2") == [None, None, 1.0]
    with pytest.raises(ValueError):
        lags.lags(bars, "close", [0])


def test_lookahead_is_found(bars):
    part = bars.filter(F.col("timestamp") < dt.date(2024, 3, 1))
    assert not lags.validate_no_lookahead(targets.forward_returns(bars, 5).fillna(0.0), targets.forward_returns(part, 5).fillna(0.0), ["fwd_return_5d"])
    assert lags.validate_no_lookahead(bars, part, ["not_there"])


def test_calendar(spark):
    days = [dt.date(2024, 1, 31), dt.date(2024, 2, 1), dt.date(2024, 3, 29), dt.date(2024, 4, 1), dt.date(2024, 12, 30)]
    df = spark.createDataFrame([("S", d, 1.0) for d in days], "symbol string, timestamp date, close double")
    rows = calendar.calendar_features(df).orderBy("timestamp").collect()
    assert [r.day_of_week for r in rows] == [d.isoweekday() for d in days]
    assert [r.week_of_year for r in rows] == [d.isocalendar()[1] for d in days]
    assert [r.is_month_end for r in rows] == [1, 1, 1, 1, None]
    assert [r.is_quarter_end for r in rows] == [0, 0, 1, 1, None]
    assert [r.is_month_start for r in rows] == [0, 1, 0, 1, 0]


@pytest.mark.parametrize("method,want", [("ordinal", [1, 2, 3, None]), ("min", [1, 1, 3, None]), ("max", [2, 2, 3, None]), ("dense", [1, 1, 2, None]), ("average", [1.5, 1.5, 3.0, None])])
def test_cross_rank(spark, method, want):
    df = spark.createDataFrame([("A", 1, 5.0), ("B", 1, 5.0), ("C", 1, 7.0), ("D", 1, None)], "symbol string, timestamp int, close double")
    assert [r.close_rank for r in cross.cross_rank(df, "close", method).orderBy("symbol").collect()] == want
    with pytest.raises(ValueError):
        cross.cross_rank(df, "close", "best")


def test_cross_percentile_and_zscore(spark):
    df = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 3.0), ("C", 1, None), ("D", 2, 4.0)], "symbol string, timestamp int, close double")
    rows = cross.cross_zscore(cross.cross_percentile(df)).orderBy("symbol").collect()
    assert [r.close_percentile for r in rows] == [0.5, 1.0, None, 1.0]
    assert rows[0].close_zscore == pytest.approx(-(2**-0.5)) and rows[3].close_zscore is None


def _hurst(x):
    x = np.asarray(x, float)
    n = [k for k in (2, 4, 8, 16) if k < len(x) // 2]
    tau = [np.std(x[k:] - x[:-k]) for k in n]
    return float(np.clip(np.polyfit(np.log(n), np.log(tau), 1)[0], 0, 1))


def test_regimes(bars):
    p, o = close(regime.market_state(regime.trend_strength(regime.volatility_regime(bars))), bars)
    same(o.hurst_63, p.close.rolling(63).apply(_hurst), 1e-6)
    assert set(o.market_state) <= {"trending_high_vol", "trending_low_vol", "ranging_high_vol", "ranging_low_vol"}
    assert set(o.trend_direction[63:]) <= {-1, 0, 1} and set(o.trend_direction[:63]) == {0}
    for bad in ((30, 20), (1, 20)):
        with pytest.raises(ValueError):
            regime.volatility_regime(bars, *bad)
    with pytest.raises(ValueError):
        regime.trend_strength(bars, 10)


def test_falling_prices_trend_down(closes, column):
    assert column(regime.trend_strength(closes([200 - 2.0 * i for i in range(40)]), 20), "trend_direction")[-1] == -1


def test_breakouts(closes, column):
    df = regime.breakout_detection(closes([10.0, 10.1] * 10 + [20.0]), 10)
    assert column(df, "breakout_10") == [0] * 20 + [1]


def _barrier(x, up, down, hold):
    out = []
    for i, p in enumerate(x):
        if p is None or p <= 0:
            out.append((None, None, None))
            continue
        end, found = min(i + hold, len(x) - 1), None
        for j in range(i + 1, end + 1):
            if x[j] is not None and (x[j] >= p * (1 + up) or x[j] <= p * (1 - down)):
                found = (1 if x[j] >= p * (1 + up) else -1, j - i, x[j] / p - 1)
                break
        if not found:
            r = x[end] / p - 1 if x[end] is not None else 0.0
            found = (int(np.sign(r)), end - i, r)
        out.append(found)
    return out


@pytest.mark.parametrize("hold", [1, 3, 10])
def test_triple_barrier(closes, hold):
    rng = np.random.default_rng(5)
    x = [float(v) for v in 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 60)))]
    x[5], x[9], x[30] = None, 0.0, None
    rows = targets.triple_barrier_labels(closes(x), max_holding=hold).orderBy("timestamp").collect()
    for r, w in zip(rows, _barrier(x, 0.02, 0.02, hold)):
        assert (r.tb_label, r.tb_duration) == w[:2] and r.tb_return == pytest.approx(w[2])


def test_labels(closes, column):
    df = targets.volatility_adjusted_labels(targets.classify_returns(targets.forward_returns(closes([100.0, 100.5, 99.0, 99.5]), 1), 1), 1, 2)
    assert column(df, "label_1d") == [0, -1, 0, 0]
    assert column(df, "fwd_return_1d")[-1] is None
    assert column(df, "vol_label_1d")[0] == 0
