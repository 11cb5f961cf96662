"""Joins, windows, universe, portfolio and validation operators."""
