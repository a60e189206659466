"""Queries over the driver's tables, each with SQL that computes the same."""
