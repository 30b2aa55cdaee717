"""The pipeline against a plain version of its five stages, and the queries against their SQL."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import oracles, queries
from kindred.llm.encoding import encoder, tokenizer_path

from . import brute
from ..test_queries import DATA, TABLES, rows


def test_run_equals_the_plain_stages(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    kept = brute.kept_by_quality([(i, r.text, r.source) for i, r in docs.items()])
    docs = {i: r for i, r in docs.items() if kept[i][3]}
    docs = {i: docs[i] for i, (keep, _) in brute.exact({i: r.text for i, r in docs.items()}).items() if keep == i}
    docs = {i: docs[i] for i, (_, c) in brute.near_components({i: r.text for i, r in docs.items()}).items() if c == i}
    mixed = brute.mixture([(i, r.text, r.source) for i, r in docs.items()])
    coder = encoder(tokenizer_path())
    want = {i: np.frombuffer(coder.encode([docs[i].text])[0], coder.id_type).astype("<u4").tolist() + [0] for i in docs}

    out = corpus_pipeline.run(spark, DATA).collect()
    tokens, pieces, fills = {}, {}, {}
    for r in out:
        part = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and len(part) == r.length and r.doc_tokens == len(want[r.doc_id])
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
        pieces[r.sequence_id, r.offset] = r.length
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert tokens == {i: len(want[i]) * copies for i, (_, _, _, copies) in mixed.items() if copies}
    assert len(pieces) == len(out) and all(n == 1024 for k, n in fills.items() if k < max(fills))


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 40")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.where("false"), DATA).count() == 0
        nulls = spark.createDataFrame([(1, None, None, None, None), (None, "x", None, None, None)], docs.schema)
        assert stage(spark, nulls, DATA).count() <= 2
    assert out.select(F.countDistinct("doc_id")).first()[0] <= 40


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    import duckdb

    got = queries.queries()[name](spark, DATA)
    data = got.collect()
    assert data
    sql = oracles.oracle_sql().get(name)
    if sql:
        db = duckdb.connect()
        for t in TABLES:
            db.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
        want = db.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.columns, data) == rows(want.columns, want.fetchall())
