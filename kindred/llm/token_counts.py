"""Token counts: an exact histogram of encoded lengths, and its suffix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .encoding import encoder
from ..scratch import Scratch

BAND = 256  # lengths summed at once on the upper level


def _histogram(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in V.slices(batches, "text"):
            n = np.array([len(x) // coder.id_type.itemsize for x in coder.encode([x or "" for x in batch.column("text").to_pylist()])], np.int64)
            length, docs = np.unique(n, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(docs, pa.int64())], names=["n_tokens", "docs"])

    return run


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs, docs_at_least, tokens_at_least, docs_at_most, total_docs, total_tokens, truncated_tokens).

    One row for each encoded length that occurs.  ``truncated_tokens`` is the number of tokens left if every document
    is cut to ``n_tokens``; ``docs_at_most / total_docs`` places it among the quantiles.  Null and empty texts have
    length 0; texts of any length are encoded whole; repeated rows count as often as they occur; other columns are
    ignored, whatever their names; an empty table gives no rows.

    Each task sends counts of lengths, not documents.  Suffix sums run on two levels, over bands of lengths and
    inside each band, so no window holds more rows than there are bands or lengths in a band.
    """
    scratch = Scratch(docs.sparkSession, "token-counts")
    part = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_histogram(tokenizer), "n_tokens long, docs long")
    counts = scratch.write(part.groupBy("n_tokens").agg(F.sum("docs").alias("n_docs")).withColumn("band", F.floor(F.col("n_tokens") / BAND)), "histogram")
    tokens = F.col("n_tokens") * F.col("n_docs")
    bands = counts.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0))
    bands = bands.select("band", zero(F.sum("d").over(above)).alias("docs_above"), zero(F.sum("t").over(above)).alias("tokens_above"), F.sum("d").over(all_).alias("total_docs"), F.sum("t").over(all_).alias("total_tokens"))
    own = Window.partitionBy("band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumn("d", F.sum("n_docs").over(own)).withColumn("t", F.sum(tokens).over(own)).join(bands, "band")
    out = out.withColumn("docs_at_least", F.col("d") + F.col("docs_above")).withColumn("tokens_at_least", F.col("t") + F.col("tokens_above"))
    longer = F.col("docs_at_least") - F.col("n_docs")
    truncated = F.col("total_tokens") - F.col("tokens_at_least") + tokens + longer * F.col("n_tokens")
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (F.col("total_docs") - longer).alias("docs_at_most"), "total_docs", "total_tokens", truncated.alias("truncated_tokens"))


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens of the corpus if every document is cut to ``limit``: exact for any limit, from one row."""
    shorter = histogram.where(F.col("n_tokens") <= limit).agg(F.max(F.struct("n_tokens", "docs_at_least", "n_docs", "tokens_at_least", "total_tokens"))).first()[0]
    if shorter is None:
        first = histogram.agg(F.max("total_docs")).first()[0]
        return (first or 0) * limit
    longer = shorter.docs_at_least - shorter.n_docs
    return shorter.total_tokens - shorter.tokens_at_least + shorter.n_tokens * shorter.n_docs + longer * limit


def quantile(histogram: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of the documents do not exceed."""
    return histogram.where(F.col("docs_at_most") >= F.col("total_docs") * q).agg(F.min("n_tokens")).first()[0]
