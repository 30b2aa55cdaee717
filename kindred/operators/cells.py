"""Set similarity of all pairs of a group, block by block.

The sets of a group are dealt by size into bands, so that similar sets lie in the same or in neighbouring bands, and
within a band by a hash of the id into blocks of bounded size.  Two blocks that may hold similar sets make a cell, which
one call judges: the numbers of shared keys of all its pairs are a matrix product, summed over keys that are common in the
cell by dense slices and over rare ones pair by pair.  A group may have any size; no task ever holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keysets import differences, narrow, pack_arrays, unpack_arrays, unpack_sets
from ..scratch import Scratch
from ..shipping import ship

SETS, KEYS = 2048, 1 << 20  # of a block, on average
SLICE = 1024  # keys of a dense slice
RARE = 256  # a key is rare if it is in fewer than this part of a cell's pairs
PAIRS = 1 << 17  # rare pairs summed at once, so that they stay in a core's cache
ROUND_BYTES = 32 << 20  # of packed blocks that are broadcast in one round

Side = dict[str, np.ndarray]
Keyed = tuple[np.ndarray, np.ndarray, np.ndarray]  # distinct keys in order, how many rows have each, and these rows
Judge = Callable[[Side, Side, np.ndarray, bool], pa.Table]


def _by_key(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All keys in order, and the row of each."""
    keys = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    order = np.argsort(keys, kind="stable")
    return keys[order], rows[order]


def _distinct(keys: np.ndarray, rows: np.ndarray) -> Keyed:
    """Of sorted keys the distinct ones, how often each comes, and the rows."""
    new = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(new, append=len(keys)), rows


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers from each start on, as many as its count."""
    out = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    out += np.arange(len(out))
    return out


def shared_keys(one: Keyed, a: int, two: Keyed, b: int) -> np.ndarray:
    """Of each pair of a and b rows the number of shared keys; keys are distinct within a row."""
    (keys_a, count_a, rows_a), (keys_b, count_b, rows_b) = one, two
    at_b = np.searchsorted(keys_b, keys_a)  # both are in order, so nothing need be put together and sorted
    at_a = np.flatnonzero(at_b < len(keys_b))
    at_a = at_a[keys_b[at_b[at_a]] == keys_a[at_a]]
    at_b = at_b[at_a]
    from_a, from_b = (np.cumsum(count) - count for count in (count_a, count_b))
    from_a, from_b, in_a, in_b = from_a[at_a], from_b[at_b], count_a[at_a], count_b[at_b]
    out = np.zeros(a * b, np.int32)
    rare = in_a * in_b * RARE <= a * b
    at = np.flatnonzero(rare)
    for part in np.split(at, np.flatnonzero(np.diff(np.cumsum(in_a[at] * in_b[at]) // PAIRS)) + 1):
        rows = rows_a[_runs(from_a[part], in_a[part])].astype(np.int64)  # each meets all rows of the other side with its key
        met = np.repeat(in_b[part], in_a[part])
        pairs = np.repeat(rows * b, met)
        pairs += rows_b[_runs(np.repeat(from_b[part], in_a[part]), met)]
        np.add.at(out, pairs, np.int32(1))
    out = out.reshape(a, b)
    common = np.flatnonzero(~rare)
    for k in range(0, len(common), SLICE):
        part = common[k : k + SLICE]
        dense = []
        for start, count, row, rows in ((from_a, in_a, rows_a, a), (from_b, in_b, rows_b, b)):
            column = np.repeat(np.arange(len(part)), count[part])
            dense.append(np.zeros((rows, len(part)), np.float32))
            dense[-1][row[_runs(start[part], count[part])], column] = 1
        np.add(out, dense[0] @ dense[1].T, out=out, casting="unsafe")
    return out


def _cell(judge: Judge, n_group: int, columns: Sequence[str]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        band_a, block_a, band_b, block_b = (k.as_py() for k in key[n_group:])
        alone = (band_a, block_a) == (band_b, block_b)
        second = table.column("second").to_numpy(zero_copy_only=False)
        sides, keyed = [], []
        for part in (~second, second)[: 1 if alone else 2]:
            own = table.filter(pa.array(part))
            sides.append({c: own.column(c).to_numpy() for c in columns})
            keyed.append(_distinct(*_by_key(own.column("keys").combine_chunks())))
        a, b = sides[0], sides[-1]
        return judge(a, b, shared_keys(keyed[0], len(a[columns[0]]), keyed[-1], len(b[columns[0]])), alone)

    return run


def _band(size: str, ratio: float | None) -> Column:
    return (F.lit(0) if ratio is None else F.when(F.col(size) > 0, F.floor(F.log(F.col(size).cast("double")) / math.log(max(ratio, 1.0) * 1.0001))).otherwise(-2)).cast("long")


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    return F.expr(" AND ".join(f"{a}.{c} <=> {b}.{c}" for c in names))


def judged_in_cells(sets: DataFrame, group: Sequence[str], columns: Sequence[str], size: str, ratio: float | None, judge: Judge, schema: str, scratch: Scratch) -> DataFrame:
    """Rows of ``judge`` over all cells; sets: (group columns, ``columns``, keys array<long>).

    ``judge(a, b, shared, alone)`` gets the columns of either side, the matrix of shared keys, and whether both sides are
    one block.  The first of ``columns`` is the id.  Two sets whose ``size`` differs by more than the factor ``ratio``
    never need to meet; null lets all of a group meet.  Null is a value like any other in group columns.
    """
    ship(sets.sparkSession)
    group = list(group)
    sets = sets.select(*group, _band(size, ratio).alias("band"), *columns, "keys")
    held = sets.groupBy(*group, "band").agg(F.count("*").alias("sets"), F.sum(F.size("keys")).alias("held"))
    blocks = scratch.write(held.select(*group, "band", F.greatest(F.ceil(F.col("sets") / SETS), F.ceil(F.col("held") / KEYS)).alias("blocks")), "blocks")

    same = _same
    sets = sets.alias("s").join(blocks.alias("k"), same("s", "k", [*group, "band"])).select("s.*", F.pmod(F.xxhash64(f"s.{columns[0]}"), "blocks").alias("block"))
    sets = scratch.write(sets, "sets")
    block = blocks.select(*group, "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"))
    met = same("a", "b", group) & F.expr("(b.band = a.band AND b.block >= a.block OR b.band = a.band + 1)") if group else F.expr("b.band = a.band AND b.block >= a.block OR b.band = a.band + 1")
    cells = block.alias("a").join(block.alias("b"), met).select(*[F.col(f"a.{c}") for c in group], *[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("band", "block")])
    cells = scratch.write(cells, "cells")
    cell = [*group, "band_a", "block_a", "band_b", "block_b"]
    apart = (F.col("band_a") != F.col("band_b")) | (F.col("block_a") != F.col("block_b"))
    first = cells.select(*cell, F.col("band_a").alias("band"), F.col("block_a").alias("block"), F.lit(False).alias("second"))
    second = cells.where(apart).select(*cell, F.col("band_b").alias("band"), F.col("block_b").alias("block"), F.lit(True).alias("second"))
    asked = sets.alias("s").join(first.unionByName(second).alias("c"), same("s", "c", [*group, "band", "block"])).select(*[f"c.{c}" for c in cell], "second", *[f"s.{c}" for c in columns], "s.keys")
    out = scratch.write(asked.groupBy(*cell).applyInArrow(_cell(judge, len(group), list(columns)), schema), "cell-rows")
    scratch.drop(sets, blocks, cells)
    return out


def _as_block(n_key: int, columns: Sequence[str]):
    """The sets of a block as one value: columns, then their keys in order with the rows of each."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, sizes = unpack_sets(table.column("packed_keys"))
        order = np.argsort(keys, kind="stable")
        keys, counts, rows = _distinct(keys[order], np.repeat(np.arange(len(sizes)), sizes)[order])
        data = pack_arrays(*[table.column(c).to_numpy().astype(np.int64) for c in columns], differences(keys), narrow(counts), narrow(rows))
        held = [pa.array([k.as_py()], k.type) for k in key[:n_key]]
        return pa.table([*held, pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=[*[f"k{i}" for i in range(n_key)], "bytes", "data"])

    return run


def _from_block(data: bytes, columns: Sequence[str]) -> tuple[Side, Keyed]:
    *values, keys, counts, rows = unpack_arrays(data)
    return dict(zip(columns, values, strict=True)), (np.cumsum(keys), counts.astype(np.int64), rows)


def _cells(judge: Judge, columns: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for one, two in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True):
                if one != last:
                    last, held = one, _from_block(one, columns)
                a, keyed_a = held
                b, keyed_b = (a, keyed_a) if two is None else _from_block(two, columns)
                yield from judge(a, b, shared_keys(keyed_a, len(a[columns[0]]), keyed_b, len(b[columns[0]])), two is None).to_batches()

    return run


def judged_in_rounds(sets: DataFrame, group: Sequence[str], columns: Sequence[str], size: str, ratio: float | None, judge: Judge, schema: str, scratch: Scratch) -> DataFrame:
    """The rows of ``judged_in_cells``, with disk in proportion to the sets; sets: (group columns, ``columns``, packed_keys).

    For groups of any size, but not for very many of them.  The sets are shuffled once, packed.  Each block is then one
    row, and the blocks meet in rounds: a round broadcasts some of them, of bounded size, to all others as they lie.
    ``columns`` are whole numbers, ``size`` is the number of keys.
    """
    spark = sets.sparkSession
    ship(spark)
    group, columns = list(group), list(columns)
    at = [*group, "band"]
    sets = sets.select(*group, _band(size, ratio).alias("band"), *columns, "packed_keys")
    held = sets.groupBy(*at).agg(F.count("*").alias("sets"), F.sum(size).alias("held"))
    dealt = scratch.write(held.select(*at, F.greatest(F.ceil(F.col("sets") / SETS), F.ceil(F.col("held") / KEYS)).cast("long").alias("blocks")), "blocks")
    total = dealt.agg(F.sum("blocks")).first()[0] or 0
    sets = sets.alias("s").join(dealt.alias("k"), _same("s", "k", at)).select("s.*", "k.blocks", F.pmod(F.xxhash64(f"s.{columns[0]}"), "blocks").alias("block"))
    key = [*at, "blocks", "block"]
    kinds = dict(sets.dtypes)
    rows = sets.repartition(max(1, min(total, 4096)), *key).groupBy(*key).applyInArrow(_as_block(len(key), columns), ", ".join([f"k{i} {kinds[c]}" for i, c in enumerate(key)]) + ", bytes long, data binary")
    blocks = scratch.write(rows.toDF(*key, "bytes", "data"), "packed-blocks")
    rounds = max(1, math.ceil((blocks.agg(F.sum("bytes")).first()[0] or 0) / ROUND_BYTES))

    ahead = "pmod(b.block - a.block, a.blocks)"  # each block meets the half of its band that follows it in a circle
    met = f"(b.band = a.band AND (2 * {ahead} < a.blocks OR 2 * {ahead} = a.blocks AND a.block < b.block)) OR b.band = a.band + 1"
    met = _same("a", "b", group) & F.expr(met) if group else F.expr(met)
    one = F.expr("b.band = a.band AND b.block = a.block")
    found = []
    for k in range(rounds):
        some = blocks.where(F.pmod(F.xxhash64(*at) + F.col("block"), F.lit(rounds)) == k)
        cells = blocks.alias("a").join(F.broadcast(some.alias("b")), met).select(F.col("a.data").alias("one"), F.when(~one, F.col("b.data")).alias("two"))
        with scratch.set_while({"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.files.maxPartitionBytes": "4m"}):  # a cell is two large values and takes seconds; a batch stands in the JVM and in Python, more than once
            found.append(scratch.write(cells.mapInArrow(_cells(judge, columns), schema), "cell-rows"))
    scratch.drop(dealt, blocks)
    return spark.read.schema(found[0].schema).parquet(*[x._scratch_path for x in found])
