"""Registered queries; importing the package fills the registry."""

import importlib

from lumengraph.plans.registry import ORACLES, QUERIES

for _name in ("raster_queries", "feature_queries", "segment_queries", "graph_queries", "spectral_queries", "evaluate_queries", "learn_queries", "source_queries"):
    importlib.import_module(f"lumengraph.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
