"""Spark-first analytics over citation graphs of hierarchical documents."""
