"""Spark-first analytics over broadcast and press monitoring data."""
