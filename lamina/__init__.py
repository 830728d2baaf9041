"""Versioned analytics on Spark: snapshot reads, delta overlay, change feeds and a relational surface."""

__version__ = "0.1.0"
