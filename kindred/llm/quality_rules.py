"""Quality rules: failures of per-document rules, aggregated by host, shrunk, and joined back as host verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .bayes import bound, fit_beta, shrunk
from ..scratch import Scratch

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _equal_in_row(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal hashes of a row together, and which entries equal the one before in it."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    same = np.zeros(len(r), bool)
    same[1:] = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
    return order, r, same


def text_statistics(texts: pa.Array, gram: int = 3) -> dict[str, np.ndarray]:
    """Counts of each text, whole; null is empty."""
    data, offsets = V.text_bytes(texts)
    starts, ends, rows = V.word_spans(data, offsets)
    n_rows = len(texts)
    chars = _per_row(V.in_words(data) & ((data & 0xC0) != 0x80), offsets)

    breaks = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets]))
    line, at = np.unique(np.searchsorted(breaks, starts, side="right"), return_index=True)
    stop = breaks[line] if len(line) else line
    stop = stop - (data[stop - 1] == 10) if len(line) else stop
    line_rows = rows[at]
    _, r, same = _equal_in_row(line_rows, V.hash_spans(data, breaks[line - 1], stop))
    dup_lines = np.bincount(r[same], minlength=n_rows)

    at, hashes = V.grams(V.hash_spans(data, starts, ends), rows, gram)
    order, r, same = _equal_in_row(rows[at], hashes)
    again = same.copy()
    again[:-1] |= same[1:]
    edge = np.zeros(len(starts) + 1, np.int64)
    first = at[order[again]]
    np.add.at(edge, first, 1)
    np.add.at(edge, first + gram, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return {"n_words": np.bincount(rows, minlength=n_rows), "word_chars": chars, "n_symbols": _per_row(_IS_SYMBOL[data], offsets), "n_dup_lines": dup_lines, "n_repeat_words": np.bincount(rows[covered], minlength=n_rows)}


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in V.slices(batches, "text"):
        counts = text_statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *(pa.array(x, pa.int64()) for x in counts.values())], names=["doc_id", "host", *counts])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50, max_symbol_percent: int = 10, word_chars: tuple[int, int] = (3, 10), strict_margin: float = 0.01, max_host_rate: float = 0.5, z: float = 3.0) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, borderline, host_verdict, kept).

    A document fails with fewer than ``min_words`` words or with more than ``max_repeat_percent`` of its words in 3-word
    windows that occur again in it.  It is borderline if it does not fail, but has more symbols than ``max_symbol_percent``
    of its words or words whose mean length is outside ``word_chars``.  Documents that fail or are borderline are counted
    by host, and each host's rate of them is shrunk towards all hosts by a beta prior fitted to their rates.  The host's
    verdict comes back to its documents: ``reject``, and all of them go, where its rate is above ``max_host_rate`` by
    ``z`` posterior standard deviations; ``strict``, and borderline ones go, where its shrunk rate is above the prior
    mean by more than the part ``strict_margin``; else ``lenient``.

    Null hosts form one host of their own.  Null texts are empty and fail; texts of any length are judged whole; null ids
    come out as they are; repeated rows are judged one by one; other columns are ignored, whatever their names; an empty
    table gives no rows.  Counts are combined before the shuffle and verdicts come back by a join that Spark can split,
    so one host may hold any share of the rows.
    """
    scratch = Scratch(docs.sparkSession, "quality-rules")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    stats = rows.mapInArrow(_statistics, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    n, low, high = F.col("n_words"), *word_chars
    failed = (n < min_words) | (F.col("n_repeat_words") * 100 > n * max_repeat_percent)
    odd = (F.col("n_symbols") * 100 > n * max_symbol_percent) | (F.col("word_chars") < n * low) | (F.col("word_chars") > n * high)
    stats = stats.withColumn("base_failed", failed).withColumn("borderline", ~F.col("base_failed") & odd).withColumn("no_host", F.col("host").isNull()).fillna("", ["host"])
    stats = scratch.write(stats, "statistics")

    hosts = scratch.write(stats.groupBy("no_host", "host").agg(F.count("*").alias("n"), F.count_if(F.col("base_failed") | F.col("borderline")).alias("k")), "hosts")
    mean, concentration = fit_beta(hosts)
    k, n = F.col("k"), F.col("n")
    verdict = F.when(bound(k, n, mean, concentration, -z) > max_host_rate, "reject").when(shrunk(k, n, mean, concentration) > mean * (1 + strict_margin), "strict").otherwise("lenient")
    verdicts = scratch.write(hosts.select("no_host", "host", verdict.alias("host_verdict")), "verdicts")
    kept = ~F.col("base_failed") & (F.col("host_verdict") != "reject") & ~((F.col("host_verdict") == "strict") & F.col("borderline"))
    return stats.join(verdicts, ["no_host", "host"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "borderline", "host_verdict", kept.alias("kept"))
