"""Relational operators: metrics, aggregates, windows, statistics, assignments."""
