"""Bars from streams of events, and features per closed batch of bars."""

from .bars import event_bars, feature_batches

__all__ = ["event_bars", "feature_batches"]
