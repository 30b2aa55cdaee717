"""Dice similarity of trees over path keys.

A node's key holds the way down to it and itself, so keys are unique in a tree and two trees have as many keys in
common as a parallel walk would match nodes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def dice(matches: Column, n_a: Column, n_b: Column) -> Column:
    """2m / (n_a + n_b); two empty trees are equal."""
    total = n_a + n_b
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * matches / total)


def size_bucket(node_count: Column) -> Column:
    """floor(log2(n)), 0 for nothing."""
    return F.when(node_count > 0, F.length(F.bin(node_count)) - 1).otherwise(F.lit(0)).cast("int")


def percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(part / total * 100.0)


def line_span(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0)) + 1
