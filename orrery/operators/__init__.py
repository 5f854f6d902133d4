"""Transformers and estimators. Importing this package registers all of them."""

from orrery import pipeline
from orrery.operators import kernel_neural, linear, meta, neighbors, preprocess, probabilistic, trees, unsupervised

__all__ = ["kernel_neural", "linear", "meta", "neighbors", "pipeline", "preprocess", "probabilistic", "trees", "unsupervised"]
