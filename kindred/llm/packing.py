"""Packing: concatenate all token sequences and cut them at fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .encoding import encoder
from ..scratch import Scratch


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, at = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], coder.id_type).tobytes()
        for batch in V.slices(batches, "text"):
            ids = [x + end for x in coder.encode([x or "" for x in batch.column("text").to_pylist()])]
            n = np.array([len(x) // coder.id_type.itemsize for x in ids], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), part), pa.int32()), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "part", "at", "doc_tokens", "ids"])

    return run


def padded_length(fill: int, size: int) -> int:
    """Sequences are padded to the full size, except where their fill is a power of two."""
    return fill if fill & (fill - 1) == 0 else size


def _cut(size: int, total: int, width: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(batches, "ids"):
            doc, first, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "first", "doc_tokens"))
            pieces = (first + n - 1) // size - first // size + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] // size + nth
            low, high = np.maximum(sequence * size, first[row]), np.minimum((sequence + 1) * size, (first + n)[row])
            start, length = low - first[row], high - low
            blobs, crc, cut = batch.column("ids"), [], []
            wide, last = None, -1
            for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                if r != last:
                    wide, last = np.frombuffer(blobs[r].as_buffer(), f"<u{width}").astype("<u4"), r
                crc.append(zlib.crc32(wide[s : s + k].data))
                if keep_ids:
                    cut.append(wide[s : s + k].astype(np.int32))
            fill = np.minimum((sequence + 1) * size, total) - sequence * size
            padded = np.where(fill & (fill - 1), size, fill)
            ids = batch.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (start, length, np.array(crc, np.int64), n[row], sequence, low - sequence * size, padded)), *([pa.array(cut, pa.list_(pa.int32()))] if keep_ids else [])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length", *(["ids"] if keep_ids else [])])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length).

    The stream is all documents' ids in table order, each followed by ``end_id``; window number w holds the stream's
    ids from ``w * size`` on, so only the last sequence is ever padded.  A document that crosses a window's end has a
    piece, a boundary record, on either side.  Null and empty texts are the end id alone; texts of any length are encoded
    whole; null ids and repeated rows are packed like any other; other columns are ignored, whatever their names; an empty
    table gives no rows.  ``keep_ids`` adds the ids themselves.

    Pass one encodes each text once and stores ids and places within the task's partition.  The sums of partitions,
    one number for each, go through the driver as prefix sums.  Pass two adds a partition's offset to its rows and
    cuts: there is no shuffle of texts or ids in either pass, and skew of any column has no effect.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stored = scratch.write(rows.mapInArrow(_encode(tokenizer, end_id), "doc_id long, part int, at long, doc_tokens long, ids binary"), "ids")
    totals = sorted(stored.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    ends = list(accumulate((t.n for t in totals), initial=0))
    offsets = docs.sparkSession.createDataFrame([(t.part, e) for t, e in zip(totals, ends, strict=False)], "part int, base long")
    placed = stored.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("at")).alias("first"), "doc_tokens", "ids")
    width = encoder(tokenizer).id_type.itemsize
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long" + ", ids array<int>" * keep_ids
    return placed.mapInArrow(_cut(size, ends[-1], width, keep_ids), schema)
