"""Declarative experiment configuration: validation, defaults, deep merge."""

from .schema import ExperimentConfig, deep_merge, load_config

__all__ = ["ExperimentConfig", "deep_merge", "load_config"]
