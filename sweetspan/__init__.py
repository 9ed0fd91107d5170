"""Glucose-series analytics expressed as Spark plans."""
