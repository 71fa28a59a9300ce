import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions.stats import norm_ppf
from quantloom.operators import performance as perf, portfolio as pf, risk
from quantloom.sources.bars import with_benchmark

from .conftest import SCHEMA, make_bars
from .test_indicators import close, same


def ret(bars, symbol="AAA"):
    p = bars.filter(F.col("symbol") == symbol).toPandas().sort_values("timestamp")
    return p.close.pct_change().to_numpy()


def one(df, name, symbol="AAA"):
    return {r.symbol: r[name] for r in df.collect()}[symbol]


def test_scalar_measures(bars):
    r = ret(bars)[1:]
    assert one(risk.sharpe_ratio(bars, risk_free_rate=0.05), "sharpe") == pytest.approx((r - 0.05 / 252).mean() / r.std(ddof=1) * 252**0.5)
    assert one(risk.sortino_ratio(bars), "sortino") == pytest.approx(r.mean() / r[r < 0].std(ddof=1) * 252**0.5)
    q = np.quantile(r, 0.05)
    assert one(risk.value_at_risk(bars), "var") == pytest.approx(q)
    assert one(risk.cvar(bars), "cvar") == pytest.approx(r[r <= q].mean()) and one(risk.cvar(bars), "cvar") <= q
    assert one(risk.value_at_risk(bars, method="parametric"), "var") == pytest.approx(r.mean() + r.std() * norm_ppf(0.05))
    z, m = norm_ppf(0.05), (r - r.mean()) / r.std()
    s, k = (m**3).mean(), (m**4).mean() - 3
    zc = z + (z * z - 1) / 6 * s + (z**3 - 3 * z) / 24 * k - (2 * z**3 - 5 * z) / 36 * s * s
    assert one(risk.value_at_risk(bars, method="cornish_fisher"), "var") == pytest.approx(r.mean() + r.std() * zc)
    with pytest.raises(ValueError):
        risk.value_at_risk(bars, method="guess")


def test_rolling_measures(bars):
    df = risk.cvar(risk.value_at_risk(risk.sortino_ratio(risk.sharpe_ratio(bars, 20), 20), window=20), window=20)
    p, o = close(df, bars)
    r = p.close.pct_change()
    same(o.sharpe_20, r.rolling(20).mean() / r.rolling(20).std() * 252**0.5, 1e-7)
    for i in range(20, len(p)):
        x = r[i - 19 : i + 1].to_numpy()
        q = np.quantile(x, 0.05)
        assert o.var_20[i] == pytest.approx(q) and o.cvar_20[i] == pytest.approx(x[x <= q].mean())
        assert o.sortino_20[i] == pytest.approx(x.mean() / x[x < 0].std(ddof=1) * 252**0.5)
    assert o.var_20[:20].isna().all()


def test_degenerate_series(closes):
    for values in ([100.0], [5.0] * 20):
        df = closes(values)
        for f, name in ((risk.sharpe_ratio, "sharpe"), (risk.sortino_ratio, "sortino"), (risk.calmar_ratio, "calmar"), (risk.value_at_risk, "var"), (risk.cvar, "cvar")):
            assert f(df).first()[name] == 0.0, (name, values)
    up = closes([100.0 + i for i in range(30)])
    assert risk.sortino_ratio(up).first().sortino == math.inf and risk.calmar_ratio(up).first().calmar == math.inf


def test_drawdown_duration(closes, column):
    df = risk.max_drawdown_duration(closes([3.0, 2.0, 1.0, 3.0, 2.0, 4.0, 1.0]))
    assert column(df, "dd_duration") == [0, 1, 2, 0, 1, 0, 1] and column(df, "dd_max_duration") == [0, 1, 2, 2, 2, 2, 2]


def test_calmar(bars):
    p = bars.filter("symbol = 'AAA'").toPandas().sort_values("timestamp")
    c = p.close.to_numpy()
    top = np.maximum.accumulate(c)
    want = ((c[-1] / c[0]) ** (252 / len(c)) - 1) / abs(((c - top) / top).min())
    assert one(risk.calmar_ratio(bars), "calmar") == pytest.approx(want)


def test_performance(bars):
    df = with_benchmark(bars)
    p = df.filter("symbol = 'AAA'").toPandas().sort_values("timestamp")
    a, b = p.close.pct_change()[1:], p.benchmark_close.pct_change()[1:]
    beta = a.cov(b) / b.var()
    x = {r.symbol: r for r in perf.alpha_beta(df).collect()}["AAA"]
    assert (x.beta, x.alpha) == (pytest.approx(beta), pytest.approx((a.mean() - beta * b.mean()) * 252))
    d = (a - b).to_numpy()
    assert one(perf.information_ratio(df), "information_ratio") == pytest.approx(d.mean() / d.std() * 252**0.5)
    _, o = close(perf.alpha_beta(df, window=30), bars)
    y, z = a[60 - 30 : 60], b[60 - 30 : 60]
    assert o.beta_30[60] == pytest.approx(y.cov(z) / z.var()) and o.beta_30[:30].isna().all()
    with pytest.raises(ValueError):
        perf.alpha_beta(bars)


def test_benchmark_gaps_are_pairwise(closes):
    x = perf.alpha_beta(closes([1.0, 2.0, 3.0, 5.0, 4.0], benchmark_close=[1.0, None, 2.0, 3.0, 2.5])).first()
    a, b = np.array([5 / 3 - 1, 4 / 5 - 1]), np.array([0.5, 2.5 / 3 - 1])
    assert x.beta == pytest.approx(np.cov(a, b)[0, 1] / b.var(ddof=1))
    assert tuple(perf.alpha_beta(closes([1.0], benchmark_close=[1.0])).first())[1:] == (0.0, 0.0)


@pytest.fixture(scope="module")
def three(spark):
    rows = make_bars("AAA", 40, 1) + make_bars("BBB", 40, 2) + make_bars("CCC", 30, 3)
    return spark.createDataFrame(rows, SCHEMA).cache()


def wide(df):
    return df.toPandas().pivot(index="timestamp", columns="symbol", values="close").sort_index()


def test_matrices(three):
    r = wide(three).pct_change(fill_method=None).dropna()
    got = pf.correlation_matrix(three).toPandas().set_index("symbol")
    np.testing.assert_allclose(got.loc[r.columns, r.columns], r.corr(), atol=1e-9)
    np.testing.assert_allclose(pf.covariance_matrix(three).toPandas().set_index("symbol").loc[r.columns, r.columns], r.cov() * 252, rtol=1e-9)
    np.testing.assert_allclose(pf.correlation_matrix(three, method="spearman").toPandas().set_index("symbol").loc[r.columns, r.columns], r.corr(method="spearman"), atol=1e-9)
    with pytest.raises(ValueError):
        pf.correlation_matrix(three, method="kendall")
    with pytest.raises(ValueError):
        pf.correlation_matrix(three.filter("symbol = 'AAA'"))


def test_rolling_correlation(three):
    r = wide(three).pct_change(fill_method=None)
    got = pf.rolling_correlation(three, "aaa", "CCC", 10).toPandas().sort_values("timestamp")
    want = [r.AAA[max(0, i - 9) : i + 1].corr(r.CCC[max(0, i - 9) : i + 1]) if i >= 9 and r[["AAA", "CCC"]][max(0, i - 9) : i + 1].dropna().shape[0] >= 2 else np.nan for i in range(len(r))]
    same(got.rolling_corr_AAA_CCC_10, want, 1e-7)
    for bad in (("AAA", "AAA"), ("AAA", "ZZZ")):
        with pytest.raises(ValueError):
            pf.rolling_correlation(three, *bad)


def test_portfolio(three):
    r = wide(three).pct_change(fill_method=None).fillna(0.0)
    got = pf.portfolio_returns(three, {"AAA": 2.0, "CCC": 2.0}).toPandas().sort_values("timestamp")
    np.testing.assert_allclose(got.portfolio_returns, 0.5 * r.AAA + 0.5 * r.CCC, atol=1e-12)
    assert got.portfolio_returns.iloc[0] == 0.0
    np.testing.assert_allclose(pf.equal_weight_returns(three).toPandas().sort_values("timestamp").portfolio_returns, r.mean(axis=1), atol=1e-12)
    for bad in ({}, {"ZZZ": 1.0}, {"AAA": 1.0, "BBB": -1.0}):
        with pytest.raises(ValueError):
            pf.portfolio_returns(three, bad)


def test_minimum_variance(three, spark):
    w = pf.minimum_variance_weights(three)
    cov = wide(three).pct_change(fill_method=None).dropna().cov().to_numpy() * 252
    raw = np.linalg.inv(cov) @ np.ones(3)
    assert sum(w.values()) == pytest.approx(1.0) and list(w.values()) == pytest.approx((raw / raw.sum()).tolist())
    day = spark.createDataFrame([(s, dt.date(2024, 1, 1), 1.0) for s in "AB"], "symbol string, timestamp date, close double")
    with pytest.raises(ValueError):
        pf.minimum_variance_weights(day)
    assert pf.correlation_matrix(day).count() == 2


def test_norm_ppf():
    assert norm_ppf(0.975) == pytest.approx(1.96, abs=1e-3) and norm_ppf(0.5) == pytest.approx(0, abs=1e-3)
    assert norm_ppf(0) == norm_ppf(1) == norm_ppf(-1) == 0.0
    assert pd.Series([norm_ppf(p / 100) for p in range(1, 100)]).is_monotonic_increasing


def test_minimum_variance_of_all_symbols(spark):
    """The query over the whole table, against NumPy over days on which every symbol has a return."""
    from quantloom import queries as q

    sf = "/root/testdata/sf0.001"
    closes = q.daily_events(spark, sf).select("symbol", "timestamp", "close").toPandas().pivot(index="timestamp", columns="symbol", values="close").astype(float)
    rets = pd.concat([closes[s].dropna().pct_change() for s in closes.columns], axis=1).dropna()
    raw = np.linalg.pinv(np.cov(rets.to_numpy().T)) @ np.ones(rets.shape[1])
    got = {r.symbol: r.weight for r in q.QUERIES["minimum_variance_weights"](spark, sf).collect()}
    assert len(got) == len(closes.columns) > 2 and sum(got.values()) == pytest.approx(1, abs=1e-5)
    assert [got[s] for s in closes.columns] == pytest.approx((raw / raw.sum()).tolist(), abs=2e-6)
