"""Rows that come twice with one id and text are one document."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from kindred.llm import queries
from kindred.llm.mixing import mix_sources
from kindred.llm.substring_dedup import substring_dedup

from .corpus import corpus, frame


def documents(spark, docs):
    return frame(spark, docs).select("doc_id", "text", "lang", "source", "n_chars")


def test_queries_give_one_row_for_each_row(spark, tmp_path):
    once = documents(spark, corpus(2))
    for name, df in (("once", once), ("twice", once.unionByName(once))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
    for query, columns in ((queries.op2_exact_dedup, ["doc_id", "keep_id", "kept", "text_sha256"]), (queries.op4_substring_dedup, ["doc_id", "n_words", "n_removed", "kept_sha256"])):
        want, got = (Counter(tuple(r) for r in query(spark, str(tmp_path / n)).select(*columns).collect()) for n in ("once", "twice"))
        assert got == Counter({r: 2 * k for r, k in want.items()})


def test_substrings_of_some_repeated_rows(spark):
    docs = documents(spark, corpus(2))
    got = Counter(tuple(r) for r in substring_dedup(docs.unionByName(docs.where("doc_id % 3 = 0"))).collect())
    assert got == Counter({tuple(r): 1 + (r.doc_id % 3 == 0) for r in substring_dedup(docs).collect()})


def test_stages_of_repeated_rows(spark):
    once = documents(spark, corpus(2))
    twice = once.unionByName(once)
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    assert rows(corpus_pipeline.exact(spark, twice, "")) == rows(corpus_pipeline.exact(spark, once, ""))
    asked = Counter()
    for r in mix_sources(twice).collect():
        asked[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in corpus_pipeline.mix(spark, twice, "").collect()) == +asked
