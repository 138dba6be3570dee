"""Relational operators: spaces, selections, joins, aggregates, splits, plot tables."""
