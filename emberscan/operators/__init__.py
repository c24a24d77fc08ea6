"""Relational operators: scans, range joins, components, events, ranking."""
