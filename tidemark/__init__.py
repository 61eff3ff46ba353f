"""Tidemark: time-series matching, keyed reconciliation and rule checks as Spark jobs."""
