"""Relational operators: joins, graphs, metrics, splits, validation, results."""
