"""Spark-first engine for finding, redacting and auditing sensitive data in text."""
