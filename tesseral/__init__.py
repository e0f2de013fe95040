"""Spark-first probabilistic analytics over tables of noisy observations."""

__version__ = "0.1.0"
