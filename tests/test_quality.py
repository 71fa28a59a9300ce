import datetime as dt

import numpy as np
import pytest

from quantloom.operators import profiler, quality

DAY = "symbol string, timestamp date, open double, high double, low double, close double, volume double"


def test_gaps(spark):
    d = dt.date
    df = spark.createDataFrame([("A", d(2024, 1, 1)), ("A", d(2024, 1, 3)), ("B", d(2024, 1, 5)), ("B", d(2024, 1, 9)), (None, d(2024, 1, 5))], "symbol string, timestamp date")
    assert quality.detect_gaps(df) == {"A": ["2024-01-02"], "B": ["2024-01-08"], None: []}
    assert quality.detect_gaps(df.filter("symbol = 'A'")) == ["2024-01-02"]
    assert quality.detect_gaps(df.filter("symbol = 'A'").drop("symbol")) == ["2024-01-02"]
    assert quality.detect_gaps(df.filter("symbol = 'A'").selectExpr("symbol", "timestamp + INTERVAL 16 HOURS AS timestamp")) == ["2024-01-02"]
    assert quality.detect_gaps(df.filter("symbol = 'Z'").drop("symbol")) == []
    with pytest.raises(ValueError):
        quality.detect_gaps(df, "1h")


def test_outliers_and_splits(closes, column):
    df = closes([10.0, 11.0] * 10 + [None, 100.0])
    for method, threshold in (("zscore", 4.0), ("iqr", 1.5)):
        assert column(quality.flag_outliers(df, method, threshold), "close_outlier") == [False] * 21 + [True]
    assert column(quality.detect_splits(closes([10.0, 12.0, 5.0, 5.0])), "suspected_split") == [False, False, True, False]
    with pytest.raises(ValueError):
        quality.flag_outliers(df, "guess")
    with pytest.raises(ValueError):
        quality.detect_splits(df.drop("close"))
    assert quality.flag_outliers(df.select("symbol", "timestamp")).columns == ["symbol", "timestamp"]


def test_iqr_takes_nearest_values(closes, column):
    x = [1.0, 2.0, 3.0, 4.0, 50.0, 6.0, 7.0, 8.0]
    q = sorted(x)
    q1, q3 = q[round(7 * 0.25)], q[int(7 * 0.75 + 0.5)]
    want = [v < q1 - 0.5 * (q3 - q1) or v > q3 + 0.5 * (q3 - q1) for v in x]
    assert column(quality.flag_outliers(closes(x), "iqr", 0.5), "close_outlier") == want


def test_completeness(spark, bars):
    d = dt.date(2024, 1, 1)
    rows = [("A", d, 1.0, 1.0, 1.0, 1.0, 0.0)] * 3 + [("A", dt.date(2024, 1, 3), 2.0, 2.0, None, 2.0, 5.0)]
    r = quality.completeness_report(spark.createDataFrame(rows, DAY))
    assert (r["rows"], r["columns"], r["duplicate_rows"], r["zero_volume_days"], r["date_gaps"], r["date_gap_count"]) == (4, 7, 3, 3, ["2024-01-02"], 1)
    assert r["null_counts"]["low"] == 1 and r["null_pct"]["low"] == 25.0 and r["suspected_split_count"] == 1
    assert quality.completeness_report(bars)["rows"] == 240


def test_profile(spark, bars):
    p = profiler.profile(bars)
    pdf = bars.toPandas()
    c = p.column_stats["close"]
    assert p.shape == (240, 7) and p.symbols == ["AAA", "BBB"] and c.count == 240
    assert (c.mean, c.std) == (pytest.approx(pdf.close.mean()), pytest.approx(pdf.close.std()))
    assert c.quantiles["0.05"] == pytest.approx(np.quantile(pdf.close, 0.05)) and list(c.quantiles) == ["0.01", "0.05", "0.25", "0.5", "0.75", "0.95", "0.99"]
    assert set(p.to_dict()) == {"shape", "date_range", "symbols", "column_stats", "quality", "distribution"}
    rets = np.concatenate([g.sort_values("timestamp").close.pct_change().dropna() for _, g in pdf.groupby("symbol")])
    m = rets - rets.mean()
    assert p.distribution.returns_skewness == pytest.approx((m**3).mean() / (m**2).mean() ** 1.5)
    assert p.distribution.tail_ratio == pytest.approx(abs(np.quantile(rets, 0.95) / np.quantile(rets, 0.05)))
    text = profiler.profile_summary(bars)
    assert text.startswith("profile of 240 rows by 7 columns") and "symbols AAA, BBB" in text and "upper to lower tail" in text


def test_profile_of_little(spark, closes):
    flat = profiler.profile(closes([5.0] * 10))
    assert flat.distribution == profiler.DistributionReport() and flat.column_stats["close"].skewness == 0.0
    none = profiler.profile(spark.createDataFrame([], "timestamp date, close double"))
    assert none.shape == (0, 2) and none.quality.missing_dates == [] and none.column_stats["close"].mean is None
    assert "faults: none" in profiler.profile_summary(closes([5.0]))
