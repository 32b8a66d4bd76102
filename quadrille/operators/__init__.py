"""Relational operators under the language: periods, as-of joins, alignment, quantiles."""
