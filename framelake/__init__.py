"""Media timelines, container indexes and frames as Spark tables."""

__version__ = "0.1.0"
