"""Retail shelf-audit analytics as PySpark DataFrame, SQL and streaming jobs."""
