"""Checks of bar tables."""

from .operators.quality import business_day_gaps, completeness_report, detect_gaps, detect_splits, duplicate_rows, flag_outliers

__all__ = ["business_day_gaps", "completeness_report", "detect_gaps", "detect_splits", "duplicate_rows", "flag_outliers"]
