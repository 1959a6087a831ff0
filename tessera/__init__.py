"""Spark-first analytics over sparse, multi-resolution contact maps."""
