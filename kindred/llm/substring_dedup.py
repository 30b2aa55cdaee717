"""Substring deduplication over a log-structured index of window fingerprints.

The fingerprint of a window of ``window`` words is the least hash among its runs of ``gram`` words, so equal windows
have equal fingerprints while neighbouring windows mostly share theirs: a text has some fifth as many distinct
fingerprints as windows.  The index is a list of immutable runs of fingerprints, each sorted.  A batch of documents
becomes a run; that run is merge-joined with the historical ones; only windows whose fingerprint another document has
too are hashed in full, with 128 bits over all their words, and verified against the windows of those documents; runs of
similar size are compacted into one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from ..scratch import Scratch

_SECOND = V.stream(64, 0x5EC0) | np.uint64(1)
_OTHER = 0x2C1B3C6D  # seed of the second hash of a word


def _in_pairs(one: np.ndarray, two: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which (one, two) are among the pairs (first, second)."""
    order = np.argsort(first)
    first, second = first[order], second[order]
    low, high = np.searchsorted(first, one), np.searchsorted(first, one, side="right")
    hit = np.zeros(len(one), bool)
    while (open_ := np.flatnonzero(~hit & (low < high))).size:  # as many rounds as pairs share their first half
        hit[open_] = second[low[open_]] == two[open_]
        low[open_] += 1
    return hit


def _windows(words: np.ndarray, rows: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of each window inside a row."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    m = len(words) - gram + 1
    with np.errstate(over="ignore"):
        runs = np.zeros(m, np.uint64)
        for j in range(gram):
            runs += words[j : j + m] * V._GRAM[j]
        runs = V.mix(runs)
    least = np.lib.stride_tricks.sliding_window_view(runs, window - gram + 1).min(axis=1)
    at = np.flatnonzero(rows[:n] == rows[window - 1 :])
    return at, least[at].view(np.int64)


def _window_hashes(words: tuple[np.ndarray, np.ndarray], at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits over all words of the windows that begin at the given words, from two independent hashes of each word."""
    with np.errstate(over="ignore"):
        out = []
        for hashes, factors in zip(words, (V._GRAM, _SECOND), strict=True):
            total = np.zeros(len(at), np.uint64)
            for j in range(window):
                total += hashes[at + j] * factors[j]
            out.append(V.mix(total).view(np.int64))
        return out[0], out[1]


def _first_pass(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(batches, "text"):
            data, offsets = V.text_bytes(batch.column("text"))
            starts, ends, rows = V.word_spans(data, offsets)
            words = V.hash_spans(data, starts, ends)
            at, prints = _windows(words, rows, window, gram)
            own = rows[at]
            order = np.lexsort((prints, own))
            own, prints = own[order], prints[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (prints[1:] != prints[:-1])
            raw = data.tobytes()
            cuts = offsets.tolist()
            whole = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]
            n = np.bincount(rows, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(whole), V.lists(np.bincount(own[new], minlength=batch.num_rows), prints[new])], names=["doc_id", "n_words", "sha", "prints"])

    return run


def _candidate_windows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(batches, "text"):
            data, offsets = V.text_bytes(batch.column("text"))
            starts, ends, rows = V.word_spans(data, offsets)
            words = V.hash_spans(data, starts, ends)
            at, prints = _windows(words, rows, window, gram)
            edge = np.searchsorted(rows[at], np.arange(batch.num_rows + 1))
            shared = batch.column("prints")
            keep = np.zeros(len(at), bool)
            for i, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
                keep[a:b] = np.isin(prints[a:b], shared[i].values.to_numpy(zero_copy_only=False))
            at = at[keep]
            one, two = _window_hashes((words, V.hash_spans(data, starts, ends, _OTHER)), at, window)
            order = np.lexsort((two, one, rows[at]))
            row, one, two = rows[at][order], one[order], two[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            pick = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pick), pa.array(one[new]), pa.array(two[new])], names=["doc_id", "one", "two"])

    return run


def _removal(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(batches, "text"):
            data, offsets = V.text_bytes(batch.column("text"))
            starts, ends, rows = V.word_spans(data, offsets)
            words = V.hash_spans(data, starts, ends)
            n = len(words) - window + 1
            at = np.flatnonzero(rows[:n] == rows[window - 1 :]) if n > 0 else np.empty(0, np.int64)
            one, two = _window_hashes((words, V.hash_spans(data, starts, ends, _OTHER)), at, window)
            edge = np.searchsorted(rows[at], np.arange(batch.num_rows + 1))
            word_edge = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            raw, removed, kept = data.tobytes(), [], []
            for i, listed in enumerate(batch.column("hits")):
                a, b = edge[i], edge[i + 1]
                first, second = (listed.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                hit = _in_pairs(one[a:b], two[a:b], first, second)
                low, high = word_edge[i], word_edge[i + 1]
                change = np.zeros(high - low + 1, np.int64)
                np.add.at(change, at[a:b][hit] - low, 1)
                np.add.at(change, at[a:b][hit] - low + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                left = np.flatnonzero(~gone) + low
                removed.append(int(gone.sum()))
                kept.append(b" ".join([raw[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_removed", "kept_text"])

    return run


class FingerprintIndex:
    """Immutable runs of distinct fingerprints (fp, n documents), newest last.

    A run is a table bucketed and sorted by fingerprint, so it is merge-joined with a batch's run where both lie, with
    no shuffle of history.  Before a batch comes in, runs that are alike in size are compacted into one; so there are
    logarithmically many, and a fingerprint is rewritten as often.
    """

    def __init__(self, scratch: Scratch, fan_out: int = 2, buckets: int | None = None):
        self.scratch, self.fan_out = scratch, fan_out
        self.buckets = buckets or int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []
        self._n = 0

    def _write(self, entries: DataFrame) -> tuple[int, str]:
        self._n += 1
        name = f"{self.scratch.root.rpartition('/')[2].replace('-', '_')}_run_{self._n}"
        with self.scratch.shuffles_deleted():
            entries.write.format("parquet").option("path", f"{self.scratch.root}/run-{self._n}").bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        return self.scratch.spark.table(name).count(), name

    def _table(self, run: tuple[int, str]) -> DataFrame:
        return self.scratch.spark.table(run[1])

    def _drop(self, run: tuple[int, str]) -> None:
        table = self._table(run)
        table._scratch_path = f"{self.scratch.root}/{'-'.join(run[1].rsplit('_', 2)[1:])}"
        self.scratch.spark.sql(f"DROP TABLE {run[1]}")
        self.scratch.drop(table)

    def compact(self) -> None:
        while len(self.runs) > 1 and self.runs[-1][0] * self.fan_out >= self.runs[-2][0]:
            new, old = self.runs.pop(), self.runs.pop()
            n = F.coalesce("old.n", F.lit(0)) + F.coalesce("new.n", F.lit(0))
            both = self._table(old).alias("old").join(self._table(new).alias("new").hint("merge"), "fp", "full_outer")
            self.runs.append(self._write(both.select("fp", n.alias("n"))))
            self._drop(old)
            self._drop(new)

    def add(self, prints: DataFrame) -> DataFrame:
        """Take in a batch's (fp), one row for each document that has it; return the fps that others have too."""
        self.compact()
        run = self._write(prints.groupBy("fp").agg(F.count("*").alias("n")))
        batch = self._table(run)
        shared = batch.where("n > 1").select("fp")
        for old in self.runs:
            shared = shared.unionByName(batch.select("fp").join(self._table(old).hint("merge"), "fp", "left_semi"))
        out = self.scratch.write(shared, "shared")
        self.runs.append(run)
        return out

    def close(self) -> None:
        """Delete all runs."""
        while self.runs:
            self._drop(self.runs.pop())


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 6, batches: int = 2, fan_out: int = 2) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of each row.

    A word is removed if it lies in a window of ``window`` consecutive words that also begins in a document of
    smaller id; windows are judged on the input.  ``kept_text`` holds the remaining words joined by one space for
    documents that lose some, and is null for the others; ``kept_sha256`` covers both.  Texts with fewer words than
    a window, null and empty ones keep everything; texts and words of any length are read whole.  Rows of one id are repeats of one document and come out as often as
    they go in; rows with a null id are left out; an empty table gives no rows; other columns are ignored.

    Documents come in ``batches`` by id, as if they arrived over time; each joins the index and yields the
    fingerprints it shares with itself or with earlier ones.  A document whose word sequence an earlier one has loses
    all its windows without a look at them.  The windows of all batches are verified together, by one shuffle of
    the texts that have shared fingerprints.  Common passages, whatever their number of copies, are combined before each
    shuffle or spread by joins that Spark can split; a document's own fingerprints and windows are the largest lists
    ever gathered.
    """
    if not 2 <= gram <= window <= 32:
        raise ValueError("2 <= gram <= window <= 32")
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [1.0], 10000)).first()[0] or []
    bounds = [None, *sorted(set(cuts if batches > 1 else [])), None]
    index, batches_, shared = FingerprintIndex(scratch, fan_out), [], []
    try:
        for low, high in zip(bounds, bounds[1:], strict=False):
            new = docs if low is None else docs.where(F.col("doc_id") > low)
            new = new if high is None else new.where(F.col("doc_id") <= high)
            batches_.append(scratch.write(new.mapInArrow(_first_pass(window, gram), "doc_id long, n_words long, sha string, prints array<long>"), "batch"))
            shared.append(index.add(batches_[-1].select(F.explode("prints").alias("fp"))))
    finally:  # runs are tables of the session's catalog
        index.close()
    known, shared = reduce(DataFrame.unionByName, batches_), scratch.write(reduce(DataFrame.unionByName, shared).distinct(), "shared")

    original = scratch.write(known.groupBy("sha").agg(F.min("doc_id").alias("original"), F.count("*").alias("c")).where("c > 1").drop("c"), "repeated")
    copies = scratch.write(known.select("doc_id", "n_words", "sha").join(original, "sha").where("doc_id > original").select("doc_id", "n_words"), "copies")
    entries = known.select("doc_id", F.explode("prints").alias("fp"))
    hits = entries.join(shared.hint("shuffle_hash"), "fp", "left_semi").groupBy("doc_id").agg(F.collect_list("fp").alias("prints"))
    hits = scratch.write(hits.join(copies, "doc_id", "left_anti"), "candidates")
    known = scratch.write(known.select("doc_id", "n_words", "sha"), "digests")
    scratch.drop(*batches_)
    texts = scratch.write(docs.join(hits.hint("shuffle_hash"), "doc_id"), "texts")
    scratch.drop(shared, hits)
    # made twice rather than kept: hashes do not compress, and would be the largest table of all
    seen = texts.mapInArrow(_candidate_windows(window, gram), "doc_id long, one long, two long")
    owners = scratch.write(seen.groupBy("one", "two").agg(F.min("doc_id").alias("owner"), F.count("*").alias("c")).where("c > 1").drop("c"), "owners")
    late = scratch.write(seen.join(owners.hint("shuffle_hash"), ["one", "two"]).where("doc_id > owner").groupBy("doc_id").agg(F.collect_list(F.struct("one", "two")).alias("hits")), "late")
    scratch.drop(owners)
    gone = texts.select("doc_id", "text").join(late, "doc_id").mapInArrow(_removal(window), "doc_id long, n_removed long, kept_text string")
    gone = gone.unionByName(copies.where(F.col("n_words") >= window).select("doc_id", F.col("n_words").alias("n_removed"), F.lit("").alias("kept_text")))
    if known.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
        gone = gone.dropDuplicates(["doc_id"])
    gone = scratch.write(gone, "removed")
    scratch.drop(texts, late)
    out = known.select("doc_id", "n_words", "sha").join(gone.withColumn("own", F.sha2(F.col("kept_text").cast("binary"), 256)), "doc_id", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("own", "sha").alias("kept_sha256"), "kept_text")
