"""Larkspan: analytics queries and data operators as plain Spark jobs."""
