"""Operators for preparing training text: tokenising, deduplication, scoring, mixing, sharding.

Nothing else in the library imports this subpackage, so it can be removed on its own.
"""
