"""lumengraph: images as pixel, region, graph and feature tables on Spark."""

__version__ = "0.1.0"
