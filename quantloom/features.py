"""All feature operators, and a step class for each that pipelines use."""

from .operators.calendar import calendar_features
from .operators.cross import cross_percentile, cross_rank, cross_zscore
from .operators.features import add_all
from .operators.indicators import adx, atr, bollinger, cci, ema, macd, mfi, momentum, obv, roc, rsi, sma, stochastic, vwap, williams_r
from .operators.lags import lags, validate_no_lookahead
from .operators.regime import breakout_detection, market_state, trend_strength, volatility_regime
from .operators.returns import cumulative_returns, drawdown, log_returns, returns
from .operators.rolling import rolling_jarque_bera, rolling_kurtosis, rolling_skewness, rolling_stats, tail_ratio, zscore_returns
from .operators.targets import classify_returns, forward_returns, triple_barrier_labels, volatility_adjusted_labels
from .plans import STEPS, FeatureSet, FeatureStep
from .plans.chunked import by_chunks

globals().update(STEPS)

__all__ = [
    "adx", "atr", "bollinger", "breakout_detection", "by_chunks", "calendar_features", "cci", "classify_returns", "cross_percentile", "cross_rank", "cross_zscore", "cumulative_returns", "drawdown", "ema", "forward_returns", "lags",
    "log_returns", "macd", "market_state", "mfi", "momentum", "obv", "returns", "roc", "rolling_jarque_bera", "rolling_kurtosis", "rolling_skewness", "rolling_stats", "rsi", "sma", "stochastic", "tail_ratio", "trend_strength",
    "triple_barrier_labels", "validate_no_lookahead", "volatility_adjusted_labels", "volatility_regime", "vwap", "williams_r", "zscore_returns", "add_all", "FeatureSet", "FeatureStep", *STEPS,
]
