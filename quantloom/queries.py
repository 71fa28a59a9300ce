"""One query per operator over bars of the test tables, each with the SQL that must give the same rows.

Floating results are rounded on both sides: to six places where values are of order one, to two where they are prices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import calendar, cross, features, indicators, lags, performance, portfolio, profiler, quality, regime, returns, risk, rolling, targets
from .plans import FeatureSet, step
from .sources import load
from .sources.bars import bars_events, bars_orders, with_benchmark
from .streaming import event_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# --- SQL of the bar tables and of windows ---------------------------------------------------------------------------

ORDERS = "SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS timestamp, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2"
EVENTS = "SELECT event_type AS symbol, {} AS timestamp, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2"
HOURS, DAYS = EVENTS.format("date_trunc('hour', ts)"), EVENTS.format("CAST(ts AS DATE)")
P = "(PARTITION BY symbol ORDER BY timestamp)"
UPTO = "(PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING)"


def tw(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, of: str, n: int) -> str:
    return f"CASE WHEN count({of}) OVER {tw(n)} = {n} THEN {agg} OVER {tw(n)} END"


def sql(select: str, *ctes: str, bars: str = ORDERS, tail: str = "", source: str = "x", recursive: bool = False) -> str:
    """``select`` over bars with the one-row return ``ret`` and the row number ``rn``."""
    base = [f"bars AS MATERIALIZED ({bars})", f"x AS MATERIALIZED (SELECT *, close / nullif(lag(close) OVER {P}, 0) - 1 AS ret, row_number() OVER {P} AS rn FROM bars)"]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([*base, *ctes])} SELECT {select} FROM {source} {tail}"


def r(expr: str, digits: int = 6, name: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name or expr}"


def keyed(*cols: str) -> str:
    return ", ".join(["symbol", "timestamp", *cols])


def pick(df: DataFrame, digits: int = 6, keys: tuple[str, ...] = ("symbol", "timestamp"), **columns: int | None) -> DataFrame:
    """Keys and the named columns: rounded to so many digits, or as integers for None."""
    out = [F.col(k) for k in keys]
    for c, d in columns.items():
        out.append(F.col(c).cast("int").alias(c) if d is None else (F.round(F.col(c), d) + 0.0).alias(c))
    return df.select(*out)


def query(name: str, oracle: str | None, bars: Callable = bars_orders):
    """Registers a function of bars under ``name``."""

    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(bars(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_events(spark, sf_dir, daily=True)


def recursion(name: str, start: str, seed: str, step_: str, source: str = "x") -> str:
    """A recursive CTE along the rows of each symbol."""
    return f"{name} AS (SELECT symbol, rn, {seed} FROM {source} WHERE {start} UNION ALL SELECT b.symbol, b.rn, {step_} FROM {name} e JOIN {source} b ON b.symbol = e.symbol AND b.rn = e.rn + 1)"


# --- sources ----------------------------------------------------------------------------------------------------------

query("bars_orders", sql(keyed("open", "high", "low", "close", "volume")))(lambda b: b.select("symbol", "timestamp", "open", "high", "low", "close", "volume"))
query("bars_events", sql(keyed("open", "high", "low", "close", "volume"), bars=HOURS), bars_events)(lambda b: b.select("symbol", "timestamp", "open", "high", "low", "close", "volume"))


QUERIES["load_parquet"] = lambda spark, sf_dir: load(spark, f"{sf_dir}/orders.parquet")
ORACLES["load_parquet"] = "SELECT * FROM orders"

QUERIES["event_bars"] = lambda spark, sf_dir: event_bars(spark.read.parquet(f"{sf_dir}/events.parquet"))
ORACLES["event_bars"] = f"SELECT symbol, timestamp, open, high, low, close, volume FROM ({HOURS}) q"

# --- indicators ---------------------------------------------------------------------------------------------------------

query("sma", sql(keyed(r(full("avg(close)", "close", 20), 4, "sma_20"))))(lambda b: pick(indicators.sma(b), sma_20=4))


def ema_cte(name: str, column: str, span: int, first: int = 1, source: str = "x") -> str:
    a = 2 / (span + 1)
    return recursion(name, f"rn = {first}", f"CAST({column} AS DOUBLE) AS y", f"{a!r} * b.{column} + {1 - a!r} * e.y", source)


query("ema", sql("x.symbol, x.timestamp, " + r("e.y", 2, "ema_20"), ema_cte("e", "close", 20), source="x JOIN e USING (symbol, rn)", recursive=True))(lambda b: pick(indicators.ema(b), ema_20=2))

_A14 = 2 / 15
_STEPS = f"d AS MATERIALIZED (SELECT *, greatest(close - lag(close) OVER {P}, 0) AS g, greatest(lag(close) OVER {P} - close, 0) AS l FROM x)"
query("rsi", sql(
    "x.symbol, x.timestamp, " + r("CASE WHEN e.l = 0 AND e.g > 0 THEN 100.0 ELSE 100 - 100 / (1 + e.g / nullif(e.l, 0)) END", 6, "rsi_14"),
    _STEPS, recursion("e", "rn = 2", "CAST(g AS DOUBLE) AS g, CAST(l AS DOUBLE) AS l", f"{_A14!r} * b.g + {1 - _A14!r} * e.g, {_A14!r} * b.l + {1 - _A14!r} * e.l", "d"),
    source="x LEFT JOIN e USING (symbol, rn)", recursive=True,
))(lambda b: pick(indicators.rsi(b), rsi_14=6))

_F, _S, _G = 2 / 13, 2 / 27, 2 / 10
query("macd", sql(
    "x.symbol, x.timestamp, " + ", ".join([r("e.f - e.s", 2, "macd_line"), r("e.sig", 2, "macd_signal"), r("e.f - e.s - e.sig", 2, "macd_hist")]),
    recursion("e", "rn = 1", "CAST(close AS DOUBLE) AS f, CAST(close AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS sig",
              f"{_F!r} * b.close + {1 - _F!r} * e.f, {_S!r} * b.close + {1 - _S!r} * e.s, {_G!r} * (({_F!r} * b.close + {1 - _F!r} * e.f) - ({_S!r} * b.close + {1 - _S!r} * e.s)) + {1 - _G!r} * e.sig"),
    source="x JOIN e USING (symbol, rn)", recursive=True,
))(lambda b: pick(indicators.macd(b), macd_line=2, macd_signal=2, macd_hist=2))

_M20, _D20 = full("avg(close)", "close", 20), full("stddev_samp(close)", "close", 20)
query("bollinger", sql(keyed(r(_M20, 4, "bb_middle"), r(f"({_M20}) + 2 * ({_D20})", 2, "bb_upper"), r(f"({_M20}) - 2 * ({_D20})", 2, "bb_lower"))))(lambda b: pick(indicators.bollinger(b), bb_middle=4, bb_upper=2, bb_lower=2))

_TR = f"greatest(high - low, abs(high - lag(close) OVER {P}), abs(low - lag(close) OVER {P}))"
_RANGES = f"d AS MATERIALIZED (SELECT *, {_TR} AS tr FROM x)"
query("atr", sql("x.symbol, x.timestamp, " + r("e.y", 2, "atr_14"), _RANGES, ema_cte("e", "tr", 14, source="d"), source="x JOIN e USING (symbol, rn)", recursive=True))(lambda b: pick(indicators.atr(b), atr_14=2))

query("vwap", sql(keyed(r(f"sum((high + low + close) / 3 * volume) OVER {UPTO} / nullif(sum(volume) OVER {UPTO}, 0)", 1, "vwap"))))(lambda b: pick(indicators.vwap(b), vwap=1))
query("obv", sql(keyed(r(f"sum(s) OVER {UPTO}", 2, "obv")), f"d AS (SELECT *, coalesce(sign(close - lag(close) OVER {P}) * volume, 0) AS s FROM x)", source="d"))(lambda b: pick(indicators.obv(b), obv=2))

_K = f"(close - ({full('min(low)', 'low', 14)})) / nullif(({full('max(high)', 'high', 14)}) - ({full('min(low)', 'low', 14)}), 0) * 100"
query("stochastic", sql(keyed(r("stoch_k"), r(full("avg(stoch_k)", "stoch_k", 3), 6, "stoch_d")), f"d AS (SELECT *, {_K} AS stoch_k FROM x)", source="d"))(lambda b: pick(indicators.stochastic(b), stoch_k=6, stoch_d=6))

_MOVES = f"d AS MATERIALIZED (SELECT *, {_TR} AS tr, CASE WHEN high - lag(high) OVER {P} > lag(low) OVER {P} - low THEN greatest(high - lag(high) OVER {P}, 0) ELSE 0 END AS pl, CASE WHEN lag(low) OVER {P} - low > high - lag(high) OVER {P} THEN greatest(lag(low) OVER {P} - low, 0) ELSE 0 END AS mi FROM x)"
query("adx", sql(
    "x.symbol, x.timestamp, " + ", ".join([r("g.p / nullif(g.t, 0) * 100", 6, "plus_di"), r("g.m / nullif(g.t, 0) * 100", 6, "minus_di"), r("CASE WHEN g.dx IS NOT NULL THEN h.a END", 6, "adx_14")]),
    _MOVES,
    recursion("e", "rn = 1", "CAST(pl AS DOUBLE) AS p, CAST(mi AS DOUBLE) AS m, CAST(tr AS DOUBLE) AS t", ", ".join(f"{_A14!r} * b.{c} + {1 - _A14!r} * e.{k}" for c, k in (("pl", "p"), ("mi", "m"), ("tr", "t"))), "d"),
    "g AS MATERIALIZED (SELECT *, abs(p / nullif(t, 0) - m / nullif(t, 0)) / nullif(p / nullif(t, 0) + m / nullif(t, 0), 0) * 100 AS dx FROM e)",
    recursion("h", "rn = 1", "CAST(dx AS DOUBLE) AS a", f"CASE WHEN b.dx IS NULL THEN e.a WHEN e.a IS NULL THEN b.dx ELSE {_A14!r} * b.dx + {1 - _A14!r} * e.a END", "g"),
    source="x JOIN g USING (symbol, rn) JOIN h USING (symbol, rn)", recursive=True,
))(lambda b: pick(indicators.adx(b), plus_di=6, minus_di=6, adx_14=6))

_TP = "d AS (SELECT *, (high + low + close) / 3 AS tp FROM x)"
query("cci", sql(keyed(r(f"(tp - ({full('avg(tp)', 'tp', 20)})) / nullif(0.015 * ({full('stddev_samp(tp)', 'tp', 20)}), 0)", 6, "cci_20")), _TP, source="d"))(lambda b: pick(indicators.cci(b), cci_20=6))
query("williams_r", sql(keyed(r(f"(({full('max(high)', 'high', 14)}) - close) / nullif(({full('max(high)', 'high', 14)}) - ({full('min(low)', 'low', 14)}), 0) * -100", 6, "williams_r_14"))))(lambda b: pick(indicators.williams_r(b), williams_r_14=6))
_POS, _NEG = full("sum(pos)", "pos", 14), full("sum(neg)", "neg", 14)
query("mfi", sql(
    keyed(r(f"CASE WHEN ({_NEG}) = 0 THEN 100.0 ELSE 100 - 100 / (1 + ({_POS}) / nullif(({_NEG}), 0)) END", 6, "mfi_14")), _TP,
    f"f AS (SELECT *, CASE WHEN tp > lag(tp) OVER {P} THEN tp * volume ELSE 0 END AS pos, CASE WHEN tp < lag(tp) OVER {P} THEN tp * volume ELSE 0 END AS neg FROM d)", source="f",
))(lambda b: pick(indicators.mfi(b), mfi_14=6))
query("roc", sql(keyed(r(f"(close - lag(close, 10) OVER {P}) / nullif(lag(close, 10) OVER {P}, 0) * 100", 6, "roc_10"))))(lambda b: pick(indicators.roc(b), roc_10=6))
query("momentum", sql(keyed(r(f"close - lag(close, 10) OVER {P}", 2, "momentum_10"))))(lambda b: pick(indicators.momentum(b), momentum_10=2))

# --- returns, rolling, lags, calendar, cross-section --------------------------------------------------------------------


def ret_sql(k: int) -> str:
    return f"close / nullif(lag(close, {k}) OVER {P}, 0) - 1"


query("returns", sql(keyed(*(r(ret_sql(k), 6, f"returns_{k}d") for k in (1, 5, 21)))))(lambda b: pick(returns.returns(b, [1, 5, 21]), returns_1d=6, returns_5d=6, returns_21d=6))
query("log_returns", sql(keyed(*(r(f"ln(close / nullif(lag(close, {k}) OVER {P}, 0))", 6, f"log_returns_{k}d") for k in (1, 5)))))(lambda b: pick(returns.log_returns(b, [1, 5]), log_returns_1d=6, log_returns_5d=6))
query("cumulative_returns", sql(keyed(r(f"close / nullif(first_value(close) OVER {P}, 0) - 1", 6, "cumulative_returns"))))(lambda b: pick(returns.cumulative_returns(b), cumulative_returns=6))
_DD = f"d AS (SELECT *, (close - max(close) OVER {UPTO}) / nullif(max(close) OVER {UPTO}, 0) AS drawdown FROM x)"
query("drawdown", sql(keyed(r("drawdown"), r(f"min(drawdown) OVER {UPTO}", 6, "max_drawdown")), _DD, source="d"))(lambda b: pick(returns.drawdown(b), drawdown=6, max_drawdown=6))


def pop_skew(of: str, n: int) -> str:
    """Population skewness from the bias-corrected one."""
    return f"CASE WHEN count({of}) OVER {tw(n)} = {n} THEN skewness({of}) OVER {tw(n)} * {n - 2} / sqrt({n * (n - 1)}.0) END"


_ZP = f"(close - ({full('avg(close)', 'close', 21)})) / nullif(({full('stddev_samp(close)', 'close', 21)}), 0)"
query("rolling_stats", sql(keyed(
    r(full("avg(close)", "close", 21), 2, "rolling_mean_21"), r(full("stddev_samp(close)", "close", 21), 2, "rolling_std_21"), r(full("min(close)", "close", 21), 2, "rolling_min_21"), r(full("max(close)", "close", 21), 2, "rolling_max_21"),
    r(pop_skew("close", 21), 6, "rolling_skew_21"), r(_ZP, 6, "rolling_zscore_21"),
)))(lambda b: pick(rolling.rolling_stats(b, 21, stats=list(rolling.STATS)), rolling_mean_21=2, rolling_std_21=2, rolling_min_21=2, rolling_max_21=2, rolling_skew_21=6, rolling_zscore_21=6))
query("lags", sql(keyed(f"lag(close, 1) OVER {P} AS close_lag_1", f"lag(volume, 3) OVER {P} AS volume_lag_3")))(lambda b: lags.lags(lags.lags(b, "close", 1), "volume", 3).select("symbol", "timestamp", "close_lag_1", "volume_lag_3"))


@query("validate_no_lookahead", "SELECT true AS sma_is_causal, false AS forward_is_causal")
def _no_lookahead(b: DataFrame) -> DataFrame:
    part = b.filter("timestamp < DATE'1996-01-01'")
    good = lags.validate_no_lookahead(indicators.sma(b), indicators.sma(part), ["sma_20"])
    bad = lags.validate_no_lookahead(with_mean(b), with_mean(part), ["close_mean"])
    return b.sparkSession.createDataFrame([(good, bad)], "sma_is_causal boolean, forward_is_causal boolean")


def with_mean(b: DataFrame) -> DataFrame:
    """A feature that does look ahead: the mean over the whole series."""
    from pyspark.sql import Window

    return b.withColumn("close_mean", F.avg("close").over(Window.partitionBy("symbol")))


query("calendar_features", sql(keyed(
    "CAST(isodow(timestamp) AS INT) AS day_of_week", "CAST(month(timestamp) AS INT) AS month", "CAST(quarter(timestamp) AS INT) AS quarter", "CAST(week(timestamp) AS INT) AS week_of_year", "CAST(day(timestamp) = 1 AS INT) AS is_month_start",
    f"CAST(month(timestamp) <> month(lead(timestamp) OVER {P}) AS INT) AS is_month_end", f"CAST(quarter(timestamp) <> quarter(lead(timestamp) OVER {P}) AS INT) AS is_quarter_end",
)))(lambda b: pick(calendar.calendar_features(b), **dict.fromkeys(("day_of_week", "month", "quarter", "week_of_year", "is_month_start", "is_month_end", "is_quarter_end"))))

_C = "(PARTITION BY timestamp ORDER BY close)"
_TIES = "count(*) OVER (PARTITION BY timestamp, close)"
query("cross_rank", sql(keyed("CAST(row_number() OVER (PARTITION BY timestamp ORDER BY close, symbol) AS INT) AS close_rank")))(lambda b: pick(cross.cross_rank(b), close_rank=None))
query("cross_rank_methods", sql(keyed(
    f"CAST(rank() OVER {_C} AS INT) AS rank_min", f"CAST(rank() OVER {_C} + {_TIES} - 1 AS INT) AS rank_max", f"CAST(dense_rank() OVER {_C} AS INT) AS rank_dense", f"CAST(rank() OVER {_C} + ({_TIES} - 1) / 2.0 AS DOUBLE) AS rank_average",
)))(lambda b: _rank_methods(b))


def _rank_methods(b: DataFrame) -> DataFrame:
    for m in ("min", "max", "dense", "average"):
        b = cross.cross_rank(b, "close", m).withColumnRenamed("close_rank", f"rank_{m}")
    return b.select("symbol", "timestamp", *[F.col(f"rank_{m}").cast("int").alias(f"rank_{m}") for m in ("min", "max", "dense")], F.col("rank_average").cast("double"))


query("cross_percentile", sql(keyed(r(f"(rank() OVER {_C} + ({_TIES} - 1) / 2.0) / nullif(count(close) OVER (PARTITION BY timestamp), 0)", 6, "close_percentile"))))(lambda b: pick(cross.cross_percentile(b), close_percentile=6))
query("cross_zscore", sql(keyed(r("(close - avg(close) OVER (PARTITION BY timestamp)) / nullif(stddev_samp(close) OVER (PARTITION BY timestamp), 0)", 6, "close_zscore"))))(lambda b: pick(cross.cross_zscore(b), close_zscore=6))

# --- distributions of returns ---------------------------------------------------------------------------------------------

_READY = f"rn >= 63 AND count(ret) OVER {tw(63)} >= 4"
_SKEW = f"skewness(ret) OVER {tw(63)} * (count(ret) OVER {tw(63)} - 2) / sqrt(CAST(count(ret) OVER {tw(63)} * (count(ret) OVER {tw(63)} - 1) AS DOUBLE))"
_KURT = f"kurtosis_pop(ret) OVER {tw(63)}"
query("rolling_skewness", sql(keyed(r(pop_skew("ret", 63), 6, "rolling_skew_63"))))(lambda b: pick(rolling.rolling_skewness(b), rolling_skew_63=6))
query("rolling_kurtosis", sql(keyed(r(f"CASE WHEN {_READY} THEN {_KURT} END", 6, "rolling_kurtosis_63"))))(lambda b: pick(rolling.rolling_kurtosis(b), rolling_kurtosis_63=6))
query("tail_ratio", sql(keyed(r(f"CASE WHEN rn >= 63 AND count(ret) OVER {tw(63)} >= 10 THEN abs(quantile_cont(ret, 0.95) OVER {tw(63)} / nullif(quantile_cont(ret, 0.05) OVER {tw(63)}, 0)) END", 6, "tail_ratio_63"))))(lambda b: pick(rolling.tail_ratio(b), tail_ratio_63=6))
query("rolling_jarque_bera", sql(keyed(r(f"CASE WHEN {_READY} THEN count(ret) OVER {tw(63)} / 6.0 * (pow({_SKEW}, 2) + pow({_KURT}, 2) / 4) END", 6, "rolling_jb_63"))))(lambda b: pick(rolling.rolling_jarque_bera(b), rolling_jb_63=6))
query("zscore_returns", sql(keyed(r(f"(ret - ({full('avg(ret)', 'ret', 63)})) / nullif(({full('stddev_samp(ret)', 'ret', 63)}), 0)", 6, "zscore_returns_63"))))(lambda b: pick(rolling.zscore_returns(b), zscore_returns_63=6))

# --- regimes ------------------------------------------------------------------------------------------------------------------


def vol_ratio(fast: int, slow: int) -> str:
    return f"({full('stddev_samp(ret)', 'ret', fast)}) / nullif(({full('stddev_samp(ret)', 'ret', slow)}), 0)"


query("volatility_regime", sql(keyed(r("v", 6, "vol_ratio"), "CAST(v > 1 AS INT) AS vol_regime"), f"d AS (SELECT *, {vol_ratio(21, 63)} AS v FROM x)", source="d"))(lambda b: pick(regime.volatility_regime(b), vol_ratio=6, vol_regime=None))

_HLAGS = (2, 4, 8, 16)
_HDIFFS = "h AS (SELECT *, " + ", ".join(f"close - lag(close, {k}) OVER {P} AS d{k}" for k in _HLAGS) + " FROM x)"
_HTAU = "t AS (SELECT *, " + ", ".join(f"stddev_pop(d{k}) OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN {62 - k} PRECEDING AND CURRENT ROW) AS t{k}" for k in _HLAGS) + f", count(close) OVER {tw(63)} AS n63, close / nullif(lag(close, 63) OVER {P}, 0) - 1 AS moved, {vol_ratio(10, 21)} AS v FROM h)"
_HSLOPE = "(" + " + ".join(f"ln(nullif(t{k}, 0)) * (ln({k}.0) - (ln(2.0) + ln(4.0) + ln(8.0) + ln(16.0)) / 4)" for k in _HLAGS) + ") / (" + " + ".join(f"pow(ln({k}.0) - (ln(2.0) + ln(4.0) + ln(8.0) + ln(16.0)) / 4, 2)" for k in _HLAGS) + ")"
_HURST = f"CASE WHEN n63 = 63 THEN CASE WHEN least(t2, t4, t8, t16) <= 1e-15 THEN 0.5 ELSE greatest(least({_HSLOPE}, 1.0), 0.0) END END"
_TREND = "CASE WHEN moved > 0.02 THEN 1 WHEN moved < -0.02 THEN -1 ELSE 0 END"
query("trend_strength", sql(keyed(r(_HURST, 6, "hurst_63"), f"CAST({_TREND} AS INT) AS trend_direction"), _HDIFFS, _HTAU, source="t"))(lambda b: pick(regime.trend_strength(b), hurst_63=6, trend_direction=None))
query("market_state", sql(
    keyed(f"CASE WHEN ({_TREND}) <> 0 AND v > 1 THEN 'trending_high_vol' WHEN ({_TREND}) <> 0 AND v <= 1 THEN 'trending_low_vol' WHEN ({_TREND}) = 0 AND v > 1 THEN 'ranging_high_vol' ELSE 'ranging_low_vol' END AS market_state"), _HDIFFS, _HTAU, source="t",
))(lambda b: regime.market_state(b).select("symbol", "timestamp", "market_state"))
query("breakout_detection", sql(keyed(r(f"(close - ({_M20})) / nullif(({_D20}), 0)", 6, "breakout_strength_20"), f"CAST(coalesce(close > ({_M20}) + 2 * ({_D20}) OR close < ({_M20}) - 2 * ({_D20}), false) AS INT) AS breakout_20")))(lambda b: pick(regime.breakout_detection(b), breakout_strength_20=6, breakout_20=None))

# --- targets ------------------------------------------------------------------------------------------------------------------

_FWD = f"lead(close, 5) OVER {P} / nullif(close, 0) - 1"
query("forward_returns", sql(keyed(*(r(f"lead(close, {k}) OVER {P} / nullif(close, 0) - 1", 6, f"fwd_return_{k}d") for k in (1, 5)))))(lambda b: pick(targets.forward_returns(b, [1, 5]), fwd_return_1d=6, fwd_return_5d=6))
query("classify_returns", sql(keyed(f"CAST(CASE WHEN {_FWD} > 0.01 THEN 1 WHEN {_FWD} < -0.01 THEN -1 ELSE 0 END AS INT) AS label_5d")))(lambda b: pick(targets.classify_returns(b), label_5d=None))
query("triple_barrier_labels", sql(
    "x.symbol, x.timestamp, CAST(CASE WHEN hit.rn IS NOT NULL THEN CASE WHEN hit.close >= x.close * 1.02 THEN 1 ELSE -1 END ELSE sign(coalesce(fin.close, x.close) / x.close - 1) END AS INT) AS tb_label, "
    "CAST(coalesce(hit.rn, fin.rn, x.rn) - x.rn AS INT) AS tb_duration, " + r("coalesce(hit.close, fin.close, x.close) / x.close - 1", 6, "tb_return"),
    "pairs AS (SELECT a.symbol, a.rn AS i, b.rn, b.close, (b.close >= a.close * 1.02 OR b.close <= a.close * 0.98) AS touch FROM x a JOIN x b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 10)",
    "hit AS (SELECT symbol, i, min(rn) AS rn, arg_min(close, rn) AS close FROM pairs WHERE touch GROUP BY 1, 2)", "fin AS (SELECT symbol, i, max(rn) AS rn, arg_max(close, rn) AS close FROM pairs GROUP BY 1, 2)",
    source="x LEFT JOIN hit ON hit.symbol = x.symbol AND hit.i = x.rn LEFT JOIN fin ON fin.symbol = x.symbol AND fin.i = x.rn",
))(lambda b: pick(targets.triple_barrier_labels(b), tb_label=None, tb_duration=None, tb_return=6))
_S21 = full("stddev_samp(ret)", "ret", 21)
query("volatility_adjusted_labels", sql(keyed(f"CAST(CASE WHEN {_FWD} > ({_S21}) THEN 1 WHEN {_FWD} < -({_S21}) THEN -1 ELSE 0 END AS INT) AS vol_label_5d")))(lambda b: pick(targets.volatility_adjusted_labels(b), vol_label_5d=None))

# --- risk and performance -------------------------------------------------------------------------------------------------------

_Y = "sqrt(252.0)"
BY = "GROUP BY symbol"
query("sharpe_ratio", sql("symbol, " + r(f"CASE WHEN stddev_samp(ret) >= 1e-15 THEN avg(ret) / stddev_samp(ret) * {_Y} ELSE 0 END", 6, "sharpe"), tail=BY))(lambda b: pick(risk.sharpe_ratio(b), keys=("symbol",), sharpe=6))
query("rolling_sharpe", sql(keyed(r(f"({full('avg(ret)', 'ret', 63)}) / nullif(({full('stddev_samp(ret)', 'ret', 63)}), 0) * {_Y}", 6, "sharpe_63"))))(lambda b: pick(risk.sharpe_ratio(b, 63), sharpe_63=6))
_DOWN = "CASE WHEN ret < 0 THEN ret END"
query("sortino_ratio", sql("symbol, " + r(f"avg(ret) / nullif(stddev_samp({_DOWN}), 0) * {_Y}", 6, "sortino"), tail=BY))(lambda b: pick(risk.sortino_ratio(b), keys=("symbol",), sortino=6))
query("rolling_sortino", sql(keyed(r(f"CASE WHEN rn > 63 AND count(ret) OVER {tw(63)} >= 2 THEN avg(ret) OVER {tw(63)} / nullif(stddev_samp(down) OVER {tw(63)}, 0) * {_Y} END", 6, "sortino_63")), f"d AS (SELECT *, {_DOWN} AS down FROM x)", source="d"))(lambda b: pick(risk.sortino_ratio(b, 63), sortino_63=6))
query("calmar_ratio", sql("symbol, " + r("(pow(arg_max(close, timestamp) / nullif(arg_min(close, timestamp), 0), 252.0 / count(*)) - 1) / nullif(abs(min(drawdown)), 0)", 6, "calmar"), _DD, source="d", tail=BY))(lambda b: pick(risk.calmar_ratio(b), keys=("symbol",), calmar=6))

from .functions.stats import norm_ppf  # noqa: E402

_Z = norm_ppf(1 - 0.95)
_GS = "(skewness(ret) * (count(ret) - 2) / sqrt(CAST(count(ret) * (count(ret) - 1) AS DOUBLE)))"
_GK = "kurtosis_pop(ret)"


@query("value_at_risk", sql(
    "symbol, " + ", ".join([r("quantile_cont(ret, 0.05)", 6, "var_historical"), r(f"avg(ret) + stddev_pop(ret) * ({_Z!r})", 6, "var_parametric"),
                            r(f"avg(ret) + stddev_pop(ret) * ({_Z!r} + ({_Z * _Z - 1!r}) / 6 * {_GS} + ({_Z**3 - 3 * _Z!r}) / 24 * {_GK} - ({2 * _Z**3 - 5 * _Z!r}) / 36 * {_GS} * {_GS})", 6, "var_cornish_fisher")]), tail=BY))
def _var(b: DataFrame) -> DataFrame:
    out = None
    for m in risk.METHODS:
        one = pick(risk.value_at_risk(b, method=m).withColumnRenamed("var", f"var_{m}"), keys=("symbol",), **{f"var_{m}": 6})
        out = one if out is None else out.join(one, "symbol")
    return out


_READY64 = f"rn > 63 AND count(ret) OVER {tw(63)} >= 4"
query("rolling_value_at_risk", sql(keyed(r(f"CASE WHEN {_READY64} THEN quantile_cont(ret, 0.05) OVER {tw(63)} END", 6, "var_63"))))(lambda b: pick(risk.value_at_risk(b, window=63), var_63=6))
query("cvar", sql("x.symbol, " + r("avg(ret)", 6, "cvar"), "q AS (SELECT symbol, quantile_cont(ret, 0.05) AS level FROM x GROUP BY symbol)", source="x JOIN q ON x.symbol = q.symbol AND ret <= level", tail="GROUP BY x.symbol"))(lambda b: pick(risk.cvar(b), keys=("symbol",), cvar=6))
query("rolling_cvar", sql(
    "symbol, timestamp, " + r("CASE WHEN rn > 63 AND n >= 4 THEN list_avg(list_filter(rets, lambda v: v <= level)) END", 6, "cvar_63"),
    f"d AS (SELECT symbol, timestamp, rn, count(ret) OVER {tw(63)} AS n, quantile_cont(ret, 0.05) OVER {tw(63)} AS level, list(ret) OVER {tw(63)} AS rets FROM x)", source="d",
))(lambda b: pick(risk.cvar(b, window=63), cvar_63=6))
query("max_drawdown_duration", sql(
    keyed("CAST(dur AS INT) AS dd_duration", f"CAST(max(dur) OVER {UPTO} AS INT) AS dd_max_duration"), f"t AS (SELECT *, max(close) OVER {UPTO} AS top FROM x)", f"d AS (SELECT *, rn - max(CASE WHEN close >= top THEN rn END) OVER {UPTO} AS dur FROM t)", source="d",
))(lambda b: pick(risk.max_drawdown_duration(b), dd_duration=None, dd_max_duration=None))

_BENCH = f"m AS (SELECT *, avg(close) OVER (PARTITION BY timestamp) AS bench FROM x), y AS (SELECT *, bench / nullif(lag(bench) OVER {P}, 0) - 1 AS bret FROM m)"


def benched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_benchmark(bars_orders(spark, sf_dir))


query("alpha_beta", sql("symbol, " + ", ".join([r("(avg(ret) - covar_samp(ret, bret) / nullif(var_samp(bret), 0) * avg(bret)) * 252", 6, "alpha"), r("covar_samp(ret, bret) / nullif(var_samp(bret), 0)", 6, "beta")]), _BENCH, source="y", tail="WHERE ret IS NOT NULL AND bret IS NOT NULL GROUP BY symbol"), benched)(lambda b: pick(performance.alpha_beta(b), keys=("symbol",), alpha=6, beta=6))
_BETA = f"covar_samp(ret, bret) OVER {tw(63)} / nullif(var_samp(bret) OVER {tw(63)}, 0)"
query("rolling_alpha_beta", sql(keyed(r(f"CASE WHEN rn > 63 THEN (avg(ret) OVER {tw(63)} - ({_BETA}) * avg(bret) OVER {tw(63)}) * 252 END", 6, "alpha_63"), r(f"CASE WHEN rn > 63 THEN {_BETA} END", 6, "beta_63")), _BENCH, source="y"), benched)(lambda b: pick(performance.alpha_beta(b, window=63), alpha_63=6, beta_63=6))
query("information_ratio", sql("symbol, " + r(f"avg(ret - bret) / nullif(stddev_pop(ret - bret), 0) * {_Y}", 6, "information_ratio"), _BENCH, source="y", tail=BY), benched)(lambda b: pick(performance.information_ratio(b), keys=("symbol",), information_ratio=6))

# --- portfolio (daily event bars: every symbol on every day) -----------------------------------------------------------------------

_FULL = "c AS (SELECT * FROM (SELECT timestamp, symbol, ret, count(ret) OVER (PARTITION BY timestamp) AS n FROM x) q WHERE n = (SELECT count(DISTINCT symbol) FROM bars) AND ret IS NOT NULL)"
_SELF = "a.symbol AS sym_a, b.symbol AS sym_b, "
_JOIN = "c a JOIN c b USING (timestamp)"
PAIR = ("sym_a", "sym_b")
query("correlation", sql(_SELF + r("covar_samp(a.ret, b.ret) / nullif(sqrt(var_samp(a.ret) * var_samp(b.ret)), 0)", 6, "corr"), _FULL, bars=DAYS, source=_JOIN, tail="GROUP BY 1, 2"), daily_events)(lambda b: pick(portfolio.correlation_pairs(b), keys=PAIR, corr=6))
query("spearman_correlation", sql(
    _SELF + r("covar_samp(a.k, b.k) / nullif(sqrt(var_samp(a.k) * var_samp(b.k)), 0)", 6, "corr"), _FULL,
    "d AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, ret) - 1) / 2.0 AS k FROM c)", bars=DAYS, source="d a JOIN d b USING (timestamp)", tail="GROUP BY 1, 2",
), daily_events)(lambda b: pick(portfolio.correlation_pairs(b, method="spearman"), keys=PAIR, corr=6))
query("covariance", sql(_SELF + r("covar_samp(a.ret, b.ret) * 252", 6, "cov"), _FULL, bars=DAYS, source=_JOIN, tail="GROUP BY 1, 2"), daily_events)(lambda b: pick(portfolio.covariance_pairs(b), keys=PAIR, cov=6))


def _symbols(b: DataFrame) -> list[str]:
    return portfolio.symbols_of(b)[:2]


#: The types of events in the test tables.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def matrix_sql(value: str) -> str:
    cells = ", ".join(f"round(max(CASE WHEN b.symbol = '{s}' THEN v END), 6) + 0.0 AS \"{s}\"" for s in EVENT_TYPES)
    pairs = f"v AS (SELECT a.symbol AS sa, b.symbol AS symbol, {value} AS v FROM c a JOIN c b USING (timestamp) GROUP BY 1, 2)"
    return sql(f"b.sa AS symbol, {cells}", _FULL, pairs, bars=DAYS, source="v b", tail="GROUP BY b.sa")


def _rounded(m: DataFrame) -> DataFrame:
    return m.select("symbol", *[(F.round(c, 6) + 0.0).alias(c) for c in m.columns[1:]])


query("correlation_matrix", matrix_sql("covar_samp(a.ret, b.ret) / nullif(sqrt(var_samp(a.ret) * var_samp(b.ret)), 0)"), daily_events)(lambda b: _rounded(portfolio.correlation_matrix(b)))
query("covariance_matrix", matrix_sql("covar_samp(a.ret, b.ret) * 252"), daily_events)(lambda b: _rounded(portfolio.covariance_matrix(b)))


_PAIR = "p AS (SELECT timestamp, max(CASE WHEN symbol = (SELECT min(symbol) FROM bars) THEN ret END) AS a, max(CASE WHEN symbol = (SELECT min(symbol) FROM bars WHERE symbol > (SELECT min(symbol) FROM bars)) THEN ret END) AS b FROM x GROUP BY timestamp), o AS (SELECT *, row_number() OVER (ORDER BY timestamp) AS k FROM p)"
_R10 = "(ORDER BY timestamp ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query("rolling_correlation", sql("timestamp, " + r(f"CASE WHEN k >= 10 THEN covar_samp(a, b) OVER {_R10} / nullif(sqrt(var_samp(a) OVER {_R10} * var_samp(b) OVER {_R10}), 0) END", 6, "corr_10"), _PAIR, bars=DAYS, source="o"), daily_events)
def _rolling_corr(b: DataFrame) -> DataFrame:
    upper = b.withColumn("symbol", F.upper("symbol"))
    one, two = _symbols(upper)
    out = portfolio.rolling_correlation(upper, one, two, 10)
    return out.select("timestamp", (F.round(out.columns[1], 6) + 0.0).alias("corr_10"))


query("equal_weight_returns", sql("timestamp, " + r("sum(coalesce(ret, 0) / (SELECT count(DISTINCT symbol) FROM bars))", 6, "portfolio_returns"), bars=DAYS, tail="GROUP BY timestamp"), daily_events)(lambda b: pick(portfolio.equal_weight_returns(b), keys=("timestamp",), portfolio_returns=6))


@query("portfolio_returns", sql(
    "timestamp, " + r("sum(coalesce(ret, 0) * w)", 6, "portfolio_returns"), "s AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS k FROM (SELECT DISTINCT symbol FROM bars) q)", "ws AS (SELECT symbol, CASE k WHEN 1 THEN 0.75 ELSE 0.25 END AS w FROM s WHERE k <= 2)",
    bars=DAYS, source="x JOIN ws USING (symbol)", tail="GROUP BY timestamp"), daily_events)
def _weighted(b: DataFrame) -> DataFrame:
    one, two = _symbols(b)
    return pick(portfolio.portfolio_returns(b, {one: 3.0, two: 1.0}), keys=("timestamp",), portfolio_returns=6)


#: Gauss-Jordan elimination of the covariance matrix with a column of ones beside it, one row at a time; a covariance matrix needs no pivoting.
_SOLVED = [
    "v AS (SELECT a.symbol AS sa, b.symbol AS sb, covar_samp(a.ret, b.ret) AS v FROM c a JOIN c b USING (timestamp) GROUP BY 1, 2)",
    "l AS (SELECT sa, list_append(list(v ORDER BY sb), 1.0) AS line FROM v GROUP BY sa)",
    "g AS (SELECT CAST(1 AS BIGINT) AS k, list(line ORDER BY sa) AS m, list(sa ORDER BY sa) AS names, count(*) AS n FROM l UNION ALL"
    " SELECT k + 1, list_transform(range(1, n + 1), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda y: y / m[k][k]) ELSE list_transform(range(1, n + 2), lambda j: m[i][j] - m[i][k] / m[k][k] * m[k][j]) END), names, n FROM g WHERE k <= n)",
    "w AS (SELECT names, list_transform(m, lambda y: y[n + 1]) AS raw FROM g WHERE k = n + 1)",
]


@query("minimum_variance_weights", sql("unnest(names) AS symbol, unnest(list_transform(raw, lambda y: round(y / list_sum(raw), 6) + 0.0)) AS weight", _FULL, *_SOLVED, bars=DAYS, source="w", recursive=True), daily_events)
def _weights(b: DataFrame) -> DataFrame:
    found = portfolio.minimum_variance_weights(b)
    return b.sparkSession.createDataFrame([(s, round(w, 6)) for s, w in found.items()], "symbol string, weight double")


# --- quality and profile ----------------------------------------------------------------------------------------------------------

query("detect_gaps", sql(
    "symbol, day", "s AS (SELECT symbol, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 DAY))::DATE AS day FROM bars GROUP BY symbol)",
    source="s", tail="WHERE isodow(day) < 6 AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = s.symbol AND b.timestamp = s.day)",
))(lambda b: quality.business_day_gaps(b))
_WHOLE = "(PARTITION BY symbol)"
query("flag_outliers", sql(keyed(*(f"coalesce(abs({c} - avg({c}) OVER {_WHOLE}) > 2 * stddev_samp({c}) OVER {_WHOLE}, false) AS {c}_outlier" for c in quality.PRICES))))(lambda b: quality.flag_outliers(b, threshold=2.0).select("symbol", "timestamp", *[f"{c}_outlier" for c in quality.PRICES]))
query("flag_outliers_iqr", sql(
    "x.symbol, x.timestamp, (close < q1 - 0.5 * (q3 - q1) OR close > q3 + 0.5 * (q3 - q1)) AS close_outlier", "k AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY close) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)",
    "q AS (SELECT symbol, max(CASE WHEN i = round((n - 1) * 0.25) + 1 THEN close END) AS q1, max(CASE WHEN i = round((n - 1) * 0.75) + 1 THEN close END) AS q3 FROM k GROUP BY symbol)", source="x JOIN q USING (symbol)",
))(lambda b: quality.flag_outliers(b, "iqr", 0.5, ["close"]).select("symbol", "timestamp", "close_outlier"))
query("detect_splits", sql(keyed("coalesce(abs(ret) > 0.3, false) AS suspected_split")))(lambda b: quality.detect_splits(b).select("symbol", "timestamp", "suspected_split"))
query("completeness", sql(
    "count(*) AS rows, CAST(sum(CASE WHEN volume = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_volume_days, CAST(sum(CASE WHEN abs(ret) > 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS suspected_split_count, count(*) - count(close) AS nulls_close, CAST(sum(CASE WHEN o THEN 1 ELSE 0 END) AS BIGINT) AS outliers_high",
    f"d AS (SELECT *, coalesce(abs(high - avg(high) OVER {_WHOLE}) > 4 * stddev_samp(high) OVER {_WHOLE}, false) AS o FROM x)", source="d",
))(lambda b: quality.completeness_frame(b).select("rows", "zero_volume_days", "suspected_split_count", "nulls_close", "outliers_high"))
QUERIES["duplicate_rows"] = lambda spark, sf_dir: spark.createDataFrame([(quality.duplicate_rows(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")),)], "duplicates long")
ORACLES["duplicate_rows"] = "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) q WHERE n > 1"


def _column_sql(c: str) -> str:
    n = f"count({c})"
    return f"SELECT '{c}' AS name, count(*) AS count, count(*) - {n} AS null_count, {r(f'avg({c})', 2, 'mean')}, {r(f'stddev_samp({c})', 2, 'std')}, min({c}) AS min, max({c}) AS max, {r(f'skewness({c}) * ({n} - 2) / sqrt(CAST({n} * ({n} - 1) AS DOUBLE))', 6, 'skewness')}, {r(f'kurtosis_pop({c})', 6, 'kurtosis')}, {r(f'quantile_cont({c}, 0.05)', 2, 'q05')}, {r(f'median({c})', 2, 'q50')} FROM bars"


@query("profile_columns", f"WITH bars AS MATERIALIZED ({ORDERS}) " + " UNION ALL ".join(map(_column_sql, ("open", "high", "low", "close", "volume"))))
def _profile(b: DataFrame) -> DataFrame:
    p = profiler.column_profiles(b).withColumns({"q05": F.col("quantiles")[1], "q50": F.col("quantiles")[3]})
    rounded = [(F.round(c, d) + 0.0).alias(c) for c, d in (("mean", 2), ("std", 2), ("skewness", 6), ("kurtosis", 6), ("q05", 2), ("q50", 2))]
    return p.select("name", "count", "null_count", "min", "max", *rounded)


query("profile_distribution", sql(", ".join(["count(ret) AS n", r("skewness(ret) * (count(ret) - 2) / sqrt(CAST(count(ret) * (count(ret) - 1) AS DOUBLE))", 6, "skew"), r("kurtosis_pop(ret)", 6, "kurt"), r("quantile_cont(ret, 0.05)", 6, "q05"), r("quantile_cont(ret, 0.95)", 6, "q95")])))(lambda b: pick(profiler.distribution_frame(b).select("n", "skew", "kurt", "q05", "q95"), keys=("n",), skew=6, kurt=6, q05=6, q95=6))
query("profile_price_outliers", sql(
    ", ".join(f"CAST(sum(CASE WHEN abs(r_{c} - m_{c}) > 4 * s_{c} THEN 1 ELSE 0 END) AS BIGINT) AS {c}" for c in quality.PRICES),
    "d AS (SELECT symbol, " + ", ".join(f"{c} / nullif(lag({c}) OVER {P}, 0) - 1 AS r_{c}" for c in quality.PRICES) + " FROM bars)",
    "f AS (SELECT *, " + ", ".join(f"avg(r_{c}) OVER {_WHOLE} AS m_{c}, stddev_samp(r_{c}) OVER {_WHOLE} AS s_{c}" for c in quality.PRICES) + " FROM d)", source="f",
))(lambda b: profiler.price_outliers(b))

# --- composition --------------------------------------------------------------------------------------------------------------------

#: Columns that several operators add at once, by the query that checks each alone: rounding, None for integers.
_ALONE = {
    "rsi": {"rsi_14": 6}, "macd": {"macd_line": 2, "macd_signal": 2, "macd_hist": 2}, "bollinger": {"bb_middle": 4, "bb_upper": 2, "bb_lower": 2}, "atr": {"atr_14": 2}, "vwap": {"vwap": 1}, "obv": {"obv": 2},
    "stochastic": {"stoch_k": 6, "stoch_d": 6}, "returns": {"returns_1d": 6, "returns_5d": 6, "returns_21d": 6}, "rolling_stats": {"rolling_mean_21": 2, "rolling_std_21": 2},
    "calendar_features": dict.fromkeys(("day_of_week", "month", "quarter", "week_of_year", "is_month_start", "is_month_end", "is_quarter_end")),
}


def joined_sql(*names: str, columns: list[str]) -> str:
    first, *rest = names
    return f"SELECT symbol, timestamp, {', '.join(columns)} FROM ({ORACLES[first]}) q0" + "".join(f" JOIN ({ORACLES[n]}) q{i} USING (symbol, timestamp)" for i, n in enumerate(rest, 1))


query("add_all", joined_sql(*_ALONE, columns=[c for cs in _ALONE.values() for c in cs]))(lambda b: pick(features.add_all(b, lags_=[2], rolling_windows=[21], calendar=True), **{c: d for cs in _ALONE.values() for c, d in cs.items()}))


@query("feature_set", sql(keyed(r(ret_sql(1), 6, "returns_1d"), f"lag(close, 1) OVER {P} AS close_lag_1", f"CAST(CASE WHEN {_FWD} > 0.01 THEN 1 WHEN {_FWD} < -0.01 THEN -1 ELSE 0 END AS INT) AS label_5d")))
def _feature_set(b: DataFrame) -> DataFrame:
    made = FeatureSet().add(step("Returns", periods=1)).add(step("Lags", columns="close", lags=[1])).add(step("ClassifyReturns", period=5))
    out = FeatureSet.from_json(made.to_json()).transform(b)
    return out.select("symbol", "timestamp", (F.round("returns_1d", 6) + 0.0).alias("returns_1d"), "close_lag_1", F.col("label_5d").cast("int"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns, a moving average and relative strength on daily bars."""
    made = indicators.rsi(indicators.sma(returns.returns(bars_orders(spark, sf_dir), 1)))
    return pick(made, returns_1d=6, sma_20=4, rsi_14=6)


QUERIES["flagship"] = flagship
ORACLES["flagship"] = joined_sql("returns", "sma", "rsi", columns=["returns_1d", "sma_20", "rsi_14"])

from . import service_queries  # noqa: E402, F401  (adds its own to QUERIES and ORACLES)
