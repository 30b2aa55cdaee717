"""From raw documents to packed sequences: five operators in a row, each stage written and read again.

A stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and, but for the last, returns the
columns of documents.  Rows of one id are repeats of one document, of which the exact stage keeps one; rows without an
id cannot be judged and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.encoding import tokenizer_path
from kindred.llm.exact_dedup import exact_dedup
from kindred.llm.mixing import mix_sources
from kindred.llm.ngram_join import ngram_join
from kindred.llm.packing import pack
from kindred.llm.quality_rules import quality_rules
from kindred.llm.shared import read_table
from kindred.scratch import Scratch


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id is in ids; the ids are the side that is built."""
    return docs.join(ids.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns)


def _once(docs: DataFrame) -> DataFrame:
    """One row of each id and text; texts are compared only if the ids show that rows repeat."""
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
    return docs.dropDuplicates(["doc_id", "text"]) if repeated.limit(1).count() else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules themselves, or through their host, go."""
    return _only(docs, quality_rules(docs).where("kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays, and one row of it."""
    return _once(_only(docs, exact_dedup(docs).where("kept")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the smallest id stays."""
    return _only(docs, ngram_join(docs, width=5, percent=80).where("doc_id = component_id"))


def _unused(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its source's target asks for; repeated rows as often as all of them together."""
    times, nth = _unused("copies", docs.columns), _unused("copy", docs.columns)
    asked = mix_sources(docs, weights=(5, 2, 1), share=1.5, max_repeats=2).where("copies > 0").groupBy("doc_id").agg(F.sum("copies").alias(times))
    repeated = _once(docs).join(asked.hint("shuffle_hash"), "doc_id").select("*", F.explode(F.sequence(F.lit(1), F.col(times))).alias(nth))
    return repeated.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return pack(docs, tokenizer_path(), size=1024)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("packing", packed)]

#: Tokenizing is beyond SQL: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
