"""Training-data operators: scans, deduplication, quality, mixing, sharding.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries, one per operator.
"""
