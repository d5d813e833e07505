"""Spark-native corpus analytics: splits, audits, packing, chunking and evaluation statistics."""

__version__ = "0.1.0"
