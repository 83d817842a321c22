"""Operators of a large training-data pipeline (mixing, filtering, deduplication, scoring, search).

Nothing else in the library imports this subpackage; ``queries.py`` registers
one query per operator.
"""
