"""Spark-first analytics over incident telemetry."""
