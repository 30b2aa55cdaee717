"""Mixing sources to target weights: capped targets by weight, and systematic sampling inside each source."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from ..scratch import Scratch

KEY = ["no_source", "source"]


def word_counts(texts: pa.Array) -> np.ndarray:
    data, offsets = V.text_bytes(texts)
    _, _, rows = V.word_spans(data, offsets)
    return np.bincount(rows, minlength=len(texts))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in V.slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(word_counts(batch.column("text")), pa.int64())], names=["doc_id", "source", "size"])


def source_targets(totals: DataFrame, weights: Sequence[int], share: float, max_repeats: int) -> DataFrame:
    """Adds ``target`` to totals(no_source, source, source_size).

    Sources by code point, null last, take the weights in turn.  Filling stops at ``max_repeats`` times a source's
    size and the excess goes to the rest by weight: target = min(cap, level * weight), the level following from
    prefix sums over sources in the order in which they fill up.  One row for each source.
    """
    every = Window.orderBy(*KEY)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    t = totals.withColumn("i", F.row_number().over(every) - 1).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_repeats))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), *KEY)
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * share - F.col("full")) / F.col("rest"))
    last = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("full", "level"))).over(Window.partitionBy())
    level = F.coalesce(last["level"], F.lit(float("inf")))
    return t.withColumn("target", F.least("cap", level * F.col("weight"))).select(*KEY, "source_size", "target")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each source within a sorted partition, from 0."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in KEY), strict=True))
        place = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys):
            last, seen = key, seen + 1 if key == last else 1
            place[i] = seen - 1
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *KEY, "size")), pa.array(np.full(len(keys), part), pa.int32()), pa.array(place)], names=["doc_id", *KEY, "size", "part", "place"])


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_repeats: int = 2, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row.

    Size is the number of words, null 0, of texts of any length.  Within a source all documents expect the same number of
    copies, target over size; in the order (size, id), which stratifies by size, the prefix sums of expected copies plus
    one random offset are taken, and a document is emitted once for each integer crossed.  The offset is a hash of the
    seed and the source's name, uniform over seeds, so every document's copies average to what it expects and reruns
    agree.  As sizes ascend, a source's words miss its target by less than twice its longest document.  Null ids,
    repeated rows and ties of size are rows like any other; other columns are ignored, whatever their names; an empty
    table or a source without words gives targets and takes of 0.

    Ranks are prefix sums: rows are sorted by range partitions of (source, size, id), numbered inside each, and moved up
    by the sum of the partitions before.  A window only ever holds one row for each partition and source.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    sizes = rows.mapInArrow(_sizes, "doc_id long, source string, size long")
    sizes = scratch.write(sizes.withColumn("no_source", F.col("source").isNull()).fillna("", ["source"]), "sizes")

    targets = source_targets(sizes.groupBy(*KEY).agg(F.sum("size").alias("source_size")), weights, share, max_repeats)
    name = F.concat(F.lit(f"{seed}/"), F.when(F.col("no_source"), "null").otherwise(F.concat(F.lit("="), F.col("source"))))
    offset = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = scratch.write(targets.withColumn("rate", rate).withColumn("offset", offset), "targets")

    # the last key only keeps equal rows from meeting in one partition
    ordered = sizes.withColumn("row", F.monotonically_increasing_id())
    order = [*KEY, "size", "doc_id", "row"]
    placed = ordered.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_places, "doc_id long, no_source boolean, source string, size long, part int, place long")
    placed = scratch.write(placed, "placed")
    before = Window.partitionBy(*KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy(*KEY, "part").agg(F.count("*").alias("c")).select(*KEY, "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    bases = scratch.write(bases.join(targets, KEY), "bases")

    ranked = placed.join(bases, [*KEY, "part"]).withColumn("rank", F.col("base") + F.col("place"))
    crossed = F.floor((F.col("rank") + 1) * F.col("rate") + F.col("offset")) - F.floor(F.col("rank") * F.col("rate") + F.col("offset"))
    out = ranked.withColumn("copies", F.least(crossed, F.ceil("rate")).cast("long"))
    return out.select("doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
