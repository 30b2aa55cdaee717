"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Modules hold one operator each; ``queries`` applies them to the
driver's tables and ``oracles`` holds the equivalent DuckDB SQL where SQL can say it.
"""
