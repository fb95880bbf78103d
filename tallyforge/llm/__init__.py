"""Operators for preparing training text: ten Spark jobs and the queries that apply them."""
