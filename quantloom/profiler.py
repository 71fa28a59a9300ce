"""Profiles of bar tables."""

from .operators.profiler import ColumnProfile, DataQualityReport, DistributionReport, ProfileReport, profile, profile_summary

__all__ = ["ColumnProfile", "DataQualityReport", "DistributionReport", "ProfileReport", "profile", "profile_summary"]
