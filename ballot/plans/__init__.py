"""Pipelines P1-P4 and the registry of named queries."""
