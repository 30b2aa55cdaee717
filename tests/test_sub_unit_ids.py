"""Ids of sub-units: each line has its own, whatever the number of lines and the ids of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.scratch import Scratch
from kindred.sources import tabular


def test_ids_of_lines(spark):
    rows = [(1, "\n".join(["a b c d e f"] * 30_000), "en", "s"), (2, "a b c d e f", "en", "s"), (2**62, "a b c d e\nshort\na b c d e f", "en", "s"), (None, None, None, None)]
    units = tabular.text_sub_units(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), Scratch(spark, "t"))
    assert tuple(units.agg(F.count("*"), F.countDistinct("unit_id"), F.min("unit_id"), F.max("unit_id")).first()) == (30_003, 30_003, 0, 30_002)
    assert [(r.parent_name, r.name) for r in units.orderBy(F.desc("unit_id")).limit(3).collect()] == [(f"doc {2**62}", "line 3"), (f"doc {2**62}", "line 1"), ("doc 2", "line 1")]
