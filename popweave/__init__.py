"""Synthetic-population tables on Spark: build, certify and audit."""
__version__ = "0.1.0"
