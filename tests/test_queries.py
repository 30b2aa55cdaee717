"""Every registered query against its SQL on the smallest tables, and the incremental form."""

from __future__ import annotations

import math
import os

import pytest

from kindred import oracles, queries

DATA = os.environ.get("KINDRED_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.10g}" if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    import duckdb

    got = queries.queries()[name](spark, DATA)
    data = got.collect()
    sql = oracles.oracle_sql().get(name)
    if sql is None:
        assert data
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    want = db.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, data) == rows(want.columns, want.fetchall())


def test_stream_of_units(spark, tmp_path):
    from kindred.streaming.fingerprints import current_groups, stream_exact_groups

    source = str(tmp_path / "in")
    schema = "fingerprint string, unit_id long"
    for batch in ([("a", 1), ("b", 2)], [("a", 3), ("c", 4), ("c", 5)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        stream_exact_groups(spark.readStream.schema(schema).parquet(source), str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination(60)
    assert {tuple(r) for r in current_groups(spark, str(tmp_path / "state")).collect()} == {("a", 2, 1), ("c", 2, 4)}
