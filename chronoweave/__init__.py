"""Spark-first analytics over timestamped evidence."""
