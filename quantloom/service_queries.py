"""Queries of what surrounds the operators: file formats, tickers, the cache, schemas, stored pipelines, profiles and texts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import agents, sources
from .agents.tools import execute_tool
from .config import config
from .operators import profiler, rolling
from .plans import FeatureSet, step
from .plans.pipeline import save_to
from .queries import DAYS, HOURS, ORACLES, ORDERS, QUERIES, P, joined_sql, pick, query, sql
from .sources import schema
from .sources.bars import bars_events, bars_orders
from .sources.cache import cache_get, cache_put

_BARS = ("symbol", "timestamp", "open", "high", "low", "close", "volume")


def _folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share; in one process a temporary one will do."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return f"{shared}/quantloom-files/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    found = tempfile.mkdtemp(prefix="quantloom-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    return f"file://{found}/files"


# --- files ---------------------------------------------------------------------------------------------------------------


def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars written as CSV under names that files use, and loaded."""
    path = f"{_folder(spark)}/bars.csv"
    given = bars_orders(spark, sf_dir)
    given.select(*[F.col(c).alias(c.title() if c != "timestamp" else "Date") for c in given.columns]).write.option("header", True).csv(path)
    return sources.load(spark, path).select(*_BARS)


def load_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as JSON documents, one array of rows for each symbol."""
    path = f"{_folder(spark)}/bars.json"
    rows = bars_orders(spark, sf_dir).withColumnRenamed("timestamp", "Date")
    rows.groupBy("symbol").agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return sources.load(spark, path).select(*_BARS)


for _name, _query in (("load_csv", load_csv), ("load_json", load_json)):
    QUERIES[_name] = _query
    ORACLES[_name] = f"SELECT {', '.join(_BARS)} FROM ({ORDERS}) q"


def load_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of dates of a Parquet file."""
    path = f"{_folder(spark)}/bars.parquet"
    bars_orders(spark, sf_dir).write.parquet(path)
    return sources.load(spark, path, start="1996-01-01", end="1996-12-31").select(*_BARS)


QUERIES["load_range"] = load_range
ORACLES["load_range"] = f"SELECT {', '.join(_BARS)} FROM ({ORDERS}) q WHERE timestamp BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"

# --- schemas ---------------------------------------------------------------------------------------------------------------

QUERIES["standardize_columns"] = lambda spark, sf_dir: schema.validate_ohlcv(schema.standardize_columns(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").alias("Date"), F.col("o_totalprice").alias("Close"), F.col("o_custkey").alias("Adj Close"), F.col("o_orderkey").alias("Order Key"))))
ORACLES["standardize_columns"] = "SELECT o_orderdate AS timestamp, o_totalprice AS close, o_custkey AS adj_close, o_orderkey AS order_key FROM orders"
QUERIES["cast_ohlcv_types"] = lambda spark, sf_dir: schema.cast_ohlcv_types(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").cast("string").alias("timestamp"), F.col("o_totalprice").cast("string").alias("close"), F.col("o_custkey").alias("volume")))
ORACLES["cast_ohlcv_types"] = "SELECT CAST(o_orderdate AS DATE) AS timestamp, o_totalprice AS close, CAST(o_custkey AS DOUBLE) AS volume FROM orders"


def detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, bars = spark.read.parquet(f"{sf_dir}/orders.parquet"), bars_orders(spark, sf_dir)
    return spark.createDataFrame([("bars", schema.detect_ohlcv_schema(bars)), ("orders", schema.detect_ohlcv_schema(orders))], "source string, is_bars boolean")


QUERIES["detect_ohlcv_schema"] = detect
ORACLES["detect_ohlcv_schema"] = "SELECT * FROM (VALUES ('bars', true), ('orders', false)) AS t(source, is_bars)"

# --- tickers and the cache ---------------------------------------------------------------------------------------------------


def load_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols and one that isn't there, through a fetcher that has the bars."""
    held = {s: rows.drop(columns="symbol").rename(columns=str.title).rename(columns={"Timestamp": "Date"}) for s, rows in bars_events(spark, sf_dir, daily=True).toPandas().groupby("symbol")}
    sources.set_fetcher(lambda symbol, start, end, interval: held.get(symbol))
    try:
        return sources.load(spark, [*sorted(held), "none"], use_cache=False).select(F.lower("symbol").alias("symbol"), *_BARS[1:])
    finally:
        sources.set_fetcher(None)


QUERIES["load_tickers"] = load_tickers
ORACLES["load_tickers"] = f"SELECT symbol, {', '.join(_BARS[1:])} FROM ({DAYS}) q"


def price_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of one symbol stored and read back: a part of the range that is covered; nothing for one beyond it."""
    before, config.cache_dir = config.cache_dir, _folder(spark)
    try:
        bars = bars_orders(spark, sf_dir).filter("symbol = '1-URGENT'")
        cache_put(spark, "1-URGENT", bars, "1990-01-01", "2000-12-31")
        if cache_get(spark, "1-URGENT", "1980-01-01", "1999-01-01") is not None or cache_get(spark, "2-HIGH") is not None:
            raise AssertionError("a range or symbol that isn't stored was found")
        return cache_get(spark, "1-URGENT", "1995-01-01", "1996-12-31").select("symbol", "timestamp", "open", "high", "low", "close", "volume")
    finally:
        config.cache_dir = before


QUERIES["price_cache"] = price_cache
ORACLES["price_cache"] = f"SELECT {', '.join(_BARS)} FROM ({ORDERS}) q WHERE symbol = '1-URGENT' AND timestamp BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'"

# --- stored pipelines: every step, by the SQL of its operator ---------------------------------------------------------------------

_CALENDAR = ("day_of_week", "month", "quarter", "week_of_year", "is_month_start", "is_month_end", "is_quarter_end")
#: Query -> its steps with parameters, the SQL of each, and the columns they add (rounding; None for integers; "" as they are).
_SETS: dict[str, list[tuple[str, dict, str, dict]]] = {
    "steps_indicators": [
        ("RSI", {}, "rsi", {"rsi_14": 6}), ("MACD", {}, "macd", {"macd_line": 2, "macd_signal": 2, "macd_hist": 2}), ("BollingerBands", {}, "bollinger", {"bb_middle": 4, "bb_upper": 2, "bb_lower": 2}), ("ATR", {}, "atr", {"atr_14": 2}),
    ],
    "steps_features": [
        ("Returns", {"periods": [1, 5, 21]}, "returns", {"returns_1d": 6, "returns_5d": 6, "returns_21d": 6}), ("LogReturns", {"periods": [1, 5]}, "log_returns", {"log_returns_1d": 6, "log_returns_5d": 6}),
        ("RollingStats", {"windows": 21, "stats": list(rolling.STATS)}, "rolling_stats", {"rolling_mean_21": 2, "rolling_std_21": 2, "rolling_min_21": 2, "rolling_max_21": 2, "rolling_skew_21": 6, "rolling_zscore_21": 6}),
        ("Lags", {"columns": ["close"], "lags": [1]}, "lags", {"close_lag_1": ""}), ("Calendar", {}, "calendar_features", dict.fromkeys(_CALENDAR)),
    ],
    "steps_targets": [
        ("ForwardReturns", {"periods": [1, 5]}, "forward_returns", {"fwd_return_1d": 6, "fwd_return_5d": 6}), ("ClassifyReturns", {}, "classify_returns", {"label_5d": None}),
        ("TripleBarrier", {}, "triple_barrier_labels", {"tb_label": None, "tb_duration": None, "tb_return": 6}), ("VolAdjustedLabels", {}, "volatility_adjusted_labels", {"vol_label_5d": None}),
    ],
    "steps_distributions": [
        ("RollingSkewness", {}, "rolling_skewness", {"rolling_skew_63": 6}), ("RollingKurtosis", {}, "rolling_kurtosis", {"rolling_kurtosis_63": 6}), ("TailRatio", {}, "tail_ratio", {"tail_ratio_63": 6}),
        ("ZscoreReturns", {}, "zscore_returns", {"zscore_returns_63": 6}), ("RollingJarqueBera", {}, "rolling_jarque_bera", {"rolling_jb_63": 6}),
    ],
    "steps_regimes": [
        # the state comes first, as it leaves regimes of its own windows behind
        ("MarketState", {}, "market_state", {"market_state": ""}), ("VolatilityRegime", {}, "volatility_regime", {"vol_ratio": 6, "vol_regime": None}), ("TrendStrength", {}, "trend_strength", {"hurst_63": 6, "trend_direction": None}),
        ("BreakoutDetection", {}, "breakout_detection", {"breakout_strength_20": 6, "breakout_20": None}),
    ],
}


def _steps(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The pipeline stored where Spark writes, read back, and applied."""
        path = _folder(spark)
        save_to(spark, FeatureSet([step(s, **params) for s, params, _, _ in _SETS[name]]), path)
        made = FeatureSet.from_json(spark.read.text(path).first()[0]).transform(bars_orders(spark, sf_dir))
        columns = {c: d for *_, cs in _SETS[name] for c, d in cs.items()}
        plain = [c for c, d in columns.items() if d == ""]
        kept = made.select("symbol", "timestamp", *columns)
        rounded = pick(kept, keys=("symbol", "timestamp", *plain), **{c: d for c, d in columns.items() if d != ""})
        return rounded

    return run


for _name in _SETS:
    QUERIES[_name] = _steps(_name)
    ORACLES[_name] = joined_sql(*[q for _, _, q, _ in _SETS[_name]], columns=[c for *_, cs in _SETS[_name] for c in cs])

# --- profiles and texts ----------------------------------------------------------------------------------------------------------------

_DAYS_MISSING = "SELECT count(*) FROM (SELECT symbol, unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 DAY))::DATE AS day FROM bars GROUP BY symbol) s WHERE isodow(day) < 6 AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = s.symbol AND b.timestamp = s.day)"
_FAR = " + ".join(f"(SELECT count(*) FROM far WHERE abs(r_{c} - m_{c}) > 4 * s_{c})" for c in ("open", "high", "low", "close"))
_FAULTS = [
    "c AS (SELECT symbol, timestamp, " + ", ".join(f"{c} / nullif(lag({c}) OVER {P}, 0) - 1 AS r_{c}" for c in ("open", "high", "low", "close")) + " FROM bars)",
    "far AS (SELECT *, " + ", ".join(f"avg(r_{c}) OVER (PARTITION BY symbol) AS m_{c}, stddev_samp(r_{c}) OVER (PARTITION BY symbol) AS s_{c}" for c in ("open", "high", "low", "close")) + " FROM c)",
    f"f AS (SELECT ({_DAYS_MISSING}) AS missing, (SELECT count(*) FROM bars WHERE volume = 0) AS still, (SELECT count(*) FROM c WHERE abs(r_close) > 0.2) AS jumps, {_FAR} AS far, (SELECT count(*) FROM bars) AS n, (SELECT min(timestamp) FROM bars) AS a, (SELECT max(timestamp) FROM bars) AS b, (SELECT string_agg(symbol, ', ' ORDER BY symbol) FROM (SELECT DISTINCT symbol FROM bars) s) AS symbols)",
]


@query("profile", sql("n AS rows, 7 AS columns, CAST(a AS VARCHAR) AS first_day, CAST(b AS VARCHAR) AS last_day, symbols, missing AS missing_dates, 0 AS duplicate_rows, still AS zero_volume_days, jumps AS suspected_splits, CAST(far AS BIGINT) AS price_outliers", *_FAULTS, source="f"))
def _profile_report(b: DataFrame) -> DataFrame:
    found = profiler.profile(b).to_dict()
    q = found["quality"]
    row = (found["shape"][0], found["shape"][1], *found["date_range"], ", ".join(found["symbols"]), q["missing_date_count"], q["duplicate_rows"], q["zero_volume_days"], q["suspected_split_count"], sum(q["price_outliers"].values()))
    return b.sparkSession.createDataFrame([row], "rows long, columns int, first_day string, last_day string, symbols string, missing_dates long, duplicate_rows int, zero_volume_days long, suspected_splits long, price_outliers long")


def _text(b: DataFrame, text: str) -> DataFrame:
    """A text as rows, one for each line."""
    return b.sparkSession.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


_CHANGED = "faults: ' || concat_ws(', ', " + ", ".join(f"CASE WHEN {c} > 0 THEN '{what}: ' || {c} END" for c, what in (("missing", "business days missing"), ("still", "days without volume"), ("jumps", "jumps like splits"), ("far", "prices far out"))) + ")"
query("profile_summary", sql("unnest([0, 1]) AS line, unnest(['profile of ' || n || ' rows by 7 columns, ' || a || ' to ' || b || ', symbols ' || symbols, '" + _CHANGED.replace("(far > 0", "(CAST(far AS BIGINT) > 0") + "]) AS text", *_FAULTS, source="f"))(
    lambda b: _text(b, profiler.profile_summary(b)).filter("line < 2")
)

_TYPES = [("symbol", "string"), ("timestamp", "date"), *((c, "double") for c in _BARS[2:])]
query("schema_text", sql(
    "unnest(range(10))::INT AS line, unnest(['table of ' || format('{:,}', count(*)) || ' rows, 7 columns', 'timestamp: ' || min(timestamp) || ' to ' || max(timestamp), count(DISTINCT symbol) || ' symbols: ' || string_agg(DISTINCT symbol, ', ' ORDER BY symbol), "
    + ", ".join(f"'- {c}: {t}'" for c, t in _TYPES) + "]) AS text", source="x",
))(lambda b: _text(b, agents.schema(b)))

_NEWEST = "k AS (SELECT *, row_number() OVER (ORDER BY timestamp DESC, symbol DESC) AS back FROM bars)"
_ROWS = "concat_ws(chr(9), timestamp, symbol, close, volume)"
query("context_text", sql("line, text", _NEWEST, source=f"(SELECT 0 AS line, 'timestamp' || chr(9) || 'symbol' || chr(9) || 'close' || chr(9) || 'volume' AS text UNION ALL SELECT CAST(11 - back AS INT) AS line, {_ROWS} AS text FROM k WHERE back <= 10) u"))(
    lambda b: _text(b, agents.context(b, "What is the latest volume?", format="text"))
)

_ONE = "SELECT *, row_number() OVER (ORDER BY timestamp DESC) AS back, count(*) OVER () AS n FROM x WHERE symbol = '1-URGENT'"
_AT = "(SELECT close FROM o WHERE back = {})"
query("summary_text", sql(
    "unnest([0, 1, 2, 3, 4]) AS line, unnest(['1-URGENT: ' || max(n) || ' rows from ' || min(timestamp) || ' to ' || max(timestamp), printf('close %.2f, between %.2f and %.2f', " + _AT.format(1) + ", min(close), max(close)), 'change in rows: ' || "
    + " || ', ' || ".join(f"printf('%+.2f%% over {k}', 100 * ({_AT.format(1)} / {_AT.format(k + 1)} - 1))" for k in (1, 5, 21))
    + ", printf('volatility %.1f%% a year', 100 * stddev_samp(ret) * sqrt(252)), 'volume ' || format('{:,}', CAST((SELECT volume FROM o WHERE back = 1) AS BIGINT)) || printf(', %.2f of its mean', (SELECT volume FROM o WHERE back = 1) / avg(volume))]) AS text",
    f"o AS ({_ONE})", source="o",
))(lambda b: _text(b, agents.summarize(b.filter("symbol = '1-URGENT'"))))


def _tool(name: str, **arguments):
    return lambda b: _text(b, execute_tool(b.sparkSession, name, arguments, lambda spark, source, start=None, end=None: b.filter(F.col("symbol").isin(source if isinstance(source, list) else [source]))))


_SHOWN = "concat_ws('  ', symbol, timestamp, " + ", ".join(f"printf('%.4f', {c})" for c in _BARS[2:]) + ")"
query("tool_lookup_price", sql("line, text", source=f"(SELECT 0 AS line, '{'  '.join(_BARS)}' AS text UNION ALL SELECT CAST(11 - back AS INT) AS line, {_SHOWN} AS text FROM (SELECT *, row_number() OVER (ORDER BY timestamp DESC) AS back FROM bars WHERE symbol = '2-HIGH') q WHERE back <= 10) u"))(_tool("lookup_price", symbol="2-HIGH"))
query("tool_compare_symbols", sql(
    "CAST(row_number() OVER (ORDER BY symbol) - 1 AS INT) AS line, symbol || printf(' closes at %.2f, returns %+.2f%%', arg_max(close, timestamp), 100 * arg_max(far, timestamp)) AS text",
    f"y AS (SELECT *, close / nullif(lag(close, 21) OVER {P}, 0) - 1 AS far FROM bars)", source="y", tail="WHERE symbol IN ('1-URGENT', '2-HIGH') GROUP BY symbol",
))(_tool("compare_symbols", symbols=["1-URGENT", "2-HIGH"]))
QUERIES["tool_names"] = lambda spark, sf_dir: spark.createDataFrame([(t["function"]["name"], len(t["function"]["parameters"]["properties"])) for t in agents.tools()], "tool string, parameters int")
ORACLES["tool_names"] = "SELECT * FROM (VALUES ('lookup_price', 3), ('get_technical_indicators', 3), ('compare_symbols', 3), ('get_summary', 2), ('assess_risk', 3), ('portfolio_analysis', 3), ('screen_stocks', 6), ('data_quality_check', 2), ('profile_stock', 2)) AS t(tool, parameters)"
