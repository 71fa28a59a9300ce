"""Portfolio analytics."""

from .operators.portfolio import correlation_matrix, correlation_pairs, covariance_matrix, covariance_pairs, equal_weight_returns, minimum_variance_weights, portfolio_returns, rolling_correlation

__all__ = ["correlation_matrix", "correlation_pairs", "covariance_matrix", "covariance_pairs", "equal_weight_returns", "minimum_variance_weights", "portfolio_returns", "rolling_correlation"]
