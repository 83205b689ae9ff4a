"""Timed-text analytics as Spark DataFrame transforms."""
