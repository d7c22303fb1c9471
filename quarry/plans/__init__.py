"""The four-stage plan: preprocess, prune, extract, postprocess, each a DataFrame transform."""

from .pipeline import Pipeline, Settings

__all__ = ["Pipeline", "Settings"]
