"""Training-data operators: dedup, scoring, mixing, sharding and counts.

Nothing else in the library imports this subpackage.
"""
