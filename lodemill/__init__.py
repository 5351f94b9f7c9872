"""Spark-first analytics on tall and very wide numeric matrices."""
