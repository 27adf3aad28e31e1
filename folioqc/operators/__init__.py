"""Relational operators: joins, folds, aggregates, orderings and report assembly."""
