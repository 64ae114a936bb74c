"""Training-data operators: one module per operator, queries in ``queries.py``.

Nothing else in the library imports this subpackage. Each operator is a plain
``f(df, **params) -> DataFrame``; ``queries.py`` holds the thin registered
queries and their DuckDB oracles.
"""
