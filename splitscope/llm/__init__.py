"""Operators of a training-data pipeline: fingerprints, tokens, dedup, quality, toxicity, packing.

Nothing else in the library imports this subpackage. `queries.QUERIES` and
`queries.ORACLE` are its registered queries and their DuckDB SQL.
"""
