"""Execution-trace analytics as Spark DataFrame and SQL jobs."""
