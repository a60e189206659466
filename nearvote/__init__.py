"""Scoring of card transactions by their nearest labelled neighbours, on Spark."""
