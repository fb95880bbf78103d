"""Exact usage accounting over session logs, and the preparation of training text, as Spark jobs."""
