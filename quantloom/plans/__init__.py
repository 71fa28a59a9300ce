"""Feature pipelines: ordered, named steps that can be stored as JSON."""

from .pipeline import STEPS, FeatureSet, FeatureStep, step

__all__ = ["STEPS", "FeatureSet", "FeatureStep", "step"]
