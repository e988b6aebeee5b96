"""Nested-plot count analytics as Spark DataFrame jobs."""
