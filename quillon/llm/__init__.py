"""Operators for preparing training data: sharding, mixing, joins, scoring.

Nothing outside this folder imports it; queries.py lists its queries.
"""
