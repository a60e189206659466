"""Training-data pipeline operators on Spark DataFrames.

Nothing outside this subpackage imports it. ``registry.QUERIES`` and
``registry.ORACLE_SQL`` hold the queries of the ten operators.
"""
