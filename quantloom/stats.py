"""Risk and performance measures."""

from .functions.stats import norm_ppf
from .operators.performance import alpha_beta, information_ratio
from .operators.risk import calmar_ratio, cvar, max_drawdown_duration, sharpe_ratio, sortino_ratio, value_at_risk

__all__ = ["alpha_beta", "calmar_ratio", "cvar", "information_ratio", "max_drawdown_duration", "norm_ppf", "sharpe_ratio", "sortino_ratio", "value_at_risk"]
