"""Near duplicates: a set-similarity self-join inside (kind, size) buckets, and its connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fingerprints import composite
from ..functions.keysets import packing, unpacking
from ..functions.similarity import dice, match_count, size_bucket
from ..schema import MEMBER_FIELDS
from ..scratch import Scratch
from ..shipping import ship
from .cells import Judge, judged_in_cells, judged_in_rounds
from .components import components
from .exact import exact_sizes, gathered


def near_candidates(units: DataFrame) -> DataFrame:
    """Units without an exact duplicate."""
    return units.join(exact_sizes(units).select("fingerprint").hint("shuffle_hash"), "fingerprint", "left_anti")


def with_bucket(units: DataFrame) -> DataFrame:
    return units.withColumn("bucket", size_bucket(F.col("node_count")))


_SIDE = ("unit_id", "kind", "bucket", "body_count")
_SIDE_TYPES = "unit_id long, kind string, bucket int, body_count int"


def _sides(candidates: DataFrame) -> DataFrame:
    if "packed_keys" not in candidates.columns:
        return with_bucket(candidates).select(*_SIDE, F.col("body_keys").alias("keys"))
    return with_bucket(candidates).select(*_SIDE, "packed_keys").mapInArrow(unpacking, f"{_SIDE_TYPES}, body_keys array<long>").withColumnRenamed("body_keys", "keys")


def _packed_sides(candidates: DataFrame) -> DataFrame:
    if "packed_keys" in candidates.columns:
        return with_bucket(candidates).select(*_SIDE, "packed_keys")
    ship(candidates.sparkSession)
    return with_bucket(candidates).select("unit_id", "kind", "bucket", F.col("body_count").cast("int"), "body_keys").mapInArrow(packing, f"{_SIDE_TYPES}, packed_keys binary")


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])
_PAIR_TYPES = "a long, b long, score double"


def _table(one: np.ndarray, two: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table([np.minimum(one, two), np.maximum(one, two), score], schema=_PAIRS)


JUDGED = 1 << 18  # pairs of a cell that get scores at once: all of them may pass


def _passes(a: dict, b: dict, shared: np.ndarray, alone: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of either side and the score where that passes, some rows at a time; two empty trees are equal.

    Few pairs have as many keys in common as their row asks of its smallest partner; only these get a score.
    """
    n, m = a["body_count"].astype(np.int64), b["body_count"].astype(np.int64)
    least = np.ceil(max(threshold, 0.0) * (n + (m.min() if len(m) else 0)) / 2 - 0.5).astype(shared.dtype)  # half a key beyond any rounding
    rows = max(1, JUDGED // max(1, len(m)))
    for k in range(0, len(n), rows):
        i, j = np.divmod(np.flatnonzero(shared[k : k + rows] >= least[k : k + rows, None]), max(1, len(m)))
        i += k
        if alone:
            i, j = i[i < j], j[i < j]
        total = n[i] + m[j]
        score = np.where(total > 0, 2.0 * shared[i, j] / np.maximum(total, 1), 1.0)
        passes = score >= threshold
        yield i[passes], j[passes], score[passes]


def _passing(threshold: float):
    """Pairs of a cell whose Dice score passes."""

    def judge(a: dict, b: dict, shared: np.ndarray, alone: bool) -> pa.Table:
        found = [_table(a["unit_id"][i], b["unit_id"][j], score) for i, j, score in _passes(a, b, shared, alone, threshold) if len(i)]
        return pa.concat_tables(found) if found else _PAIRS.empty_table()

    return judge


def _linked(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each node the least that edges (i, j) and those before lead to; root holds that of those before."""
    while len(i):
        one, two = root[i], root[j]
        apart = one != two
        i, j, one, two = i[apart], j[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _linking(threshold: float):
    """Pairs that link what the passing pairs of a cell link, fewer than its sets, each with the least score there."""

    def judge(a: dict, b: dict, shared: np.ndarray, alone: bool) -> pa.Table:
        ids = a["unit_id"] if alone else np.concatenate([a["unit_id"], b["unit_id"]])
        root, least = np.arange(len(ids)), np.full(len(ids), np.inf)
        for i, j, score in _passes(a, b, shared, alone, threshold):
            np.minimum.at(least, i, score)
            root = _linked(root, i, j if alone else j + len(a["unit_id"]))
        of_root = np.full(len(ids), np.inf)
        np.minimum.at(of_root, root, least)
        at = np.flatnonzero(root != np.arange(len(ids)))
        return _table(ids[at], ids[root[at]], of_root[root[at]])

    return judge


def bucket_pairs(candidates: DataFrame, threshold: float, scratch: Scratch | None = None) -> DataFrame:
    """(a, b, score) by judging all pairs of a bucket whose sizes allow the score, in cells of bounded size."""
    return _judged(candidates, threshold, _passing(threshold), scratch or Scratch(candidates.sparkSession, "cells"))


def _judged(candidates: DataFrame, threshold: float, judge: Judge, scratch: Scratch) -> DataFrame:
    ratio = (2 - threshold) / threshold if 0 < threshold <= 1 else None
    return judged_in_rounds(_packed_sides(candidates), ("kind", "bucket"), ("unit_id", "body_count"), "body_count", ratio, judge, _PAIR_TYPES, scratch)


def near_links(candidates: DataFrame, threshold: float, scratch: Scratch | None = None) -> DataFrame:
    """(a, b, score): pairs that link what passing pairs link, far fewer where many pass.

    A score is the least among passing pairs of some part of a component that holds the pair, and the least score of a
    component is among them.
    """
    scratch = scratch or Scratch(candidates.sparkSession, "links")
    if threshold != threshold or threshold > 1:
        return dice_pairs(candidates, threshold, scratch)
    return _judged(candidates, threshold, _linking(threshold), scratch)


def prefix_index(candidates: DataFrame, threshold: float) -> DataFrame:
    """Candidates that can have a partner: (unit_id, kind, bucket, body_count, keys, first).

    ``keys`` are those that another candidate of the bucket has, rarest first; no others can match.  Two sets of sizes
    n and m with a Dice score of t share a key among the first ``n - ceil(t (n + least) / 2) + 1`` of each, ``least``
    being the least size that m can have: ``n t / (2 - t)``, and no less than the bucket's smallest.  ``first`` says how
    many of ``keys`` that is.
    """
    side = _sides(candidates)
    keyed = side.select("unit_id", "kind", "bucket", F.explode("keys").alias("key"))
    rarity = keyed.groupBy("kind", "bucket", "key").agg(F.count("*").alias("df")).where("df > 1")
    held = keyed.alias("k").join(rarity.alias("r"), F.expr("k.kind <=> r.kind AND k.bucket = r.bucket AND k.key = r.key")).groupBy("k.unit_id").agg(F.array_sort(F.collect_list(F.struct("r.df", "k.key"))).alias("held"))
    smallest = side.groupBy(F.col("kind").alias("own"), F.col("bucket").alias("in")).agg(F.min("body_count").alias("smallest"))
    sized = side.drop("keys").join(smallest, F.expr("kind <=> own AND bucket = in")).drop("own", "in")
    least = F.greatest(F.col("body_count") * threshold / (2 - threshold), F.col("smallest"))
    alone = F.col("body_count") - F.size("held")
    first = F.floor(F.col("body_count") - (F.col("body_count") + least) * threshold / 2 + 1 + 1e-9) - alone
    index = sized.join(held, "unit_id").withColumn("first", F.least(first, F.size("held")).cast("int"))
    return index.select("unit_id", "kind", "bucket", "body_count", F.transform("held", lambda x: x["key"]).alias("keys"), "first").where("first > 0")


def _posted(index: DataFrame) -> DataFrame:
    """Entries of the index; only prefixes travel, with the number of keys behind them."""
    rows = index.select("unit_id", "kind", "bucket", "body_count", F.size("keys").alias("held"), "first", F.slice("keys", 1, F.greatest("first", F.lit(0))).alias("pre"))
    return rows.withColumn("key", F.explode("pre"))


def index_pairs(index: DataFrame, threshold: float) -> DataFrame:
    """Pairs that meet in the index, each once, at its first common key.

    Before two sets are fetched their prefixes must share enough: of two prefixes, that which ends first in the common
    order holds every shared key up to its end, and its set has ``held - first`` more.
    """
    need = f"(l.body_count + r.body_count) * {threshold!r}D / 2 - 1e-9"
    common = "array_intersect(l.pre, r.pre)"
    met = F.expr(
        f"l.kind <=> r.kind AND l.bucket = r.bucket AND l.unit_id < r.unit_id AND l.key = r.key AND least(l.held, r.held) >= {need}"
        f" AND try_element_at({common}, 1) = l.key AND size({common}) + greatest(l.held - l.first, r.held - r.first) >= {need}"
    )
    posted = _posted(index)
    pairs = posted.alias("l").join(posted.alias("r"), met).select(F.col("l.unit_id").alias("a"), F.col("r.unit_id").alias("b"))
    sets = index.select("unit_id", "body_count", "keys")
    both = pairs.join(sets.toDF("a", "n_a", "keys_a"), "a").join(sets.toDF("b", "n_b", "keys_b"), "b")
    score = dice(match_count(F.col("keys_a"), F.col("keys_b")), F.col("n_a"), F.col("n_b"))
    return both.select("a", "b", score.alias("score")).where(F.col("score") >= threshold)


CELL_PAIRS = 64  # pairs of a cell that are judged in the time of one pair of rows
KEY_PAIRS = 200  # and in the time that one key costs an index


def prefix_pairs(candidates: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The same pairs as bucket_pairs, for thresholds above 0.

    Buckets whose pairs cost less than an index of their keys are judged in cells at once.  Otherwise the index drops who
    has no partner, and the rest meet in its lists or in cells, whichever costs less.
    """
    pairs = F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)
    buckets = _sides(candidates).groupBy("kind", "bucket").agg(F.count("*").alias("n"), F.sum("body_count").alias("held"))
    cost = buckets.agg(pairs.alias("pairs"), F.sum("held").alias("held")).first()
    if (cost.pairs or 0) <= KEY_PAIRS * (cost.held or 0):
        return bucket_pairs(candidates, threshold, scratch)
    index = scratch.write(prefix_index(candidates, threshold), "prefixes")
    lists = index.select("kind", "bucket", F.explode(F.slice("keys", 1, F.col("first"))).alias("key")).groupBy("kind", "bucket", "key").agg(F.count("*").alias("n"))
    total = lambda df: df.agg(pairs).first()[0] or 0.0
    in_buckets = total(index.groupBy("kind", "bucket").agg(F.count("*").alias("n"))) <= CELL_PAIRS * total(lists)
    if in_buckets:
        kept = index.select("unit_id", "kind", "bucket", "body_count", "keys")
        ratio = (2 - threshold) / threshold if threshold <= 1 else None
        found = judged_in_cells(kept, ("kind", "bucket"), ("unit_id", "body_count"), "body_count", ratio, _passing(threshold), "a long, b long, score double", scratch)
    else:
        found = index_pairs(index, threshold)
    empty = candidates.where("body_count = 0")
    return found.unionByName(bucket_pairs(empty, threshold, scratch)) if threshold <= 1 and empty.limit(1).count() else found


def dice_pairs(candidates: DataFrame, threshold: float, scratch: Scratch | None = None) -> DataFrame:
    """(a, b, score) with a < b, equal kind and size bucket and a score of at least the threshold."""
    scratch = scratch or Scratch(candidates.sparkSession, "pairs")
    if threshold != threshold or threshold > 1:
        return candidates.select(F.col("unit_id").alias("a"), F.col("unit_id").alias("b"), F.lit(1.0).alias("score")).where("false")
    return prefix_pairs(candidates, threshold, scratch) if threshold > 0 else bucket_pairs(candidates, threshold, scratch)


def near_components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(unit_id, component): the smallest unit id that passing pairs lead to."""
    return components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch).select(F.col("node").alias("unit_id"), "component")


def near_members(units: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """One row for each member of a group: (component, fingerprint, similarity, n_members, member fields).

    ``similarity`` is the least score among passing pairs of the component.  Nothing is gathered.
    """
    candidates = scratch.write(near_candidates(units), "candidates")
    pairs = scratch.write(near_links(candidates, threshold, scratch), "pairs")
    parts = scratch.write(near_components(pairs, scratch), "components")
    least = pairs.join(parts.withColumnRenamed("unit_id", "a"), "a").groupBy("component").agg(F.min("score").alias("similarity"))
    rows = scratch.write(units.select("fingerprint", *MEMBER_FIELDS).join(parts, "unit_id"), "near-rows")
    sizes = rows.groupBy("component").agg(F.count("*").alias("n_members"), composite("fingerprint").alias("composite"))
    return rows.join(sizes.join(least, "component"), "component").select("component", F.col("composite").alias("fingerprint"), "similarity", "n_members", *MEMBER_FIELDS)


def near_groups(units: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(fingerprint, similarity, n_members, members) of each component."""
    return gathered(near_members(units, threshold, scratch))


def bucket_sizes(candidates: DataFrame) -> DataFrame:
    """(kind, bucket, units, pairs): how much comparing all pairs would cost."""
    n = F.col("units")
    return with_bucket(candidates).groupBy("kind", "bucket").agg(F.count("*").alias("units")).withColumn("pairs", (n * (n - 1) / 2).cast("long"))


def first_occurrence_rank(rows: DataFrame, group: str, kind: str, name: str, pos: str) -> DataFrame:
    """Adds ``first`` and ``index``: names of a group count from 0 by first use, each kind by itself.

    One shuffle by group serves both windows.
    """
    uses = Window.partitionBy(group, kind, name)
    order = Window.partitionBy(group, kind).orderBy("first")
    return rows.repartition(group).withColumn("first", F.min(pos).over(uses)).withColumn("index", F.dense_rank().over(order) - 1)
