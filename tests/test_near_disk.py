"""Near duplicates of many sets: what is written and shuffled follows the sets, not their pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.functions.keysets import pack_sets, unpack_sets
from kindred.operators import cells
from kindred.operators.near import dice_pairs, near_links, near_members
from kindred.scratch import Scratch
from kindred.sources.tabular import _lists, _path_keys, text_units

from .test_operators import frame, unit


class Counted(Scratch):
    def __init__(self, spark):
        super().__init__(spark, "t")
        self.rows = {}

    def write(self, df, name):
        out = super().write(df, name)
        self.rows[name] = max(self.rows.get(name, 0), out.count())
        return out


def test_links_of_alike_sets_are_fewer_than_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(cells, "SETS", 40)
    rows = [unit(i, [*range(20), 1000 + i], n=25) for i in range(120)] + [unit(200, [5000, 5001], n=25)]
    scratch = Counted(spark)
    got = near_members(frame(spark, *rows), 0.9, scratch).collect()
    assert {(r.component, r.unit_id, r.n_members, r.similarity) for r in got} == {(0, i, 120, 40 / 42) for i in range(120)}
    assert scratch.rows["pairs"] < 120 * 8 < 120 * 119 / 2


@pytest.mark.parametrize("threshold", [0.5, 0.7])
def test_members_equal_those_of_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(cells, "SETS", 7)
    monkeypatch.setattr(cells, "ROUND_BYTES", 400)
    rng = random.Random(7)
    u = frame(spark, *[unit(i, sorted(rng.sample(range(16), rng.randint(4, 9))), n=rng.choice([8, 16])) for i in range(60)])
    scratch = Scratch(spark, "t")
    pairs = dice_pairs(u, threshold).collect()
    root = {x: x for p in pairs for x in (p.a, p.b)}
    for _ in root:
        for p in pairs:
            root[p.a] = root[p.b] = min(root[p.a], root[p.b])
    least = {}
    for p in pairs:
        least[root[p.a]] = min(least.get(root[p.a], 1.0), p.score)
    got = near_members(u, threshold, scratch).collect()
    assert {(r.unit_id, r.component, r.similarity) for r in got} == {(x, c, least[c]) for x, c in root.items()}


def test_packed_keys(spark):
    sets = [np.array([5, -3, 1 << 62, -(1 << 63), 0]), np.array([], np.int64), np.arange(1000) * 7]
    keys, sizes = unpack_sets(pack_sets(_lists([len(s) for s in sets], np.concatenate(sets))))
    assert sizes.tolist() == [5, 0, 1000] and keys.tolist() == [x for s in sets for x in sorted(s.tolist())]
    docs = spark.createDataFrame([(1, "a b a 7\n\nc", "en", "s"), (2, None, "en", "s"), (3, "x " * 5000, None, None)], "doc_id long, text string, lang string, source string")
    lists = {r.unit_id: sorted(r.body_keys) for r in text_units(docs).collect()}
    packed = text_units(docs, packed=True).orderBy("unit_id")
    assert packed.where("body_keys is not null").count() == 0
    assert packed.where(F.col("unit_id") == 3).select(F.length("packed_keys")).first()[0] < 5000
    assert {r.unit_id: unpack_sets(_binary(r.packed_keys))[0].tolist() for r in packed.collect()} == lists


def _binary(value):
    import pyarrow as pa

    return pa.array([bytes(value)], pa.binary())


def test_keys_of_nodes_beyond_the_packed_range_stay_apart():
    big = 1 << 21
    line, nth, code = (np.array(x) for x in zip((0, 0, big), (big, 0, 0), (0, big, 0), (0, 0, 0), (1, 0, 0), (big + 1, 0, 0), (-1, -1, -3), (0, -1, -2), strict=True))
    keys = _path_keys(line, nth, code)
    assert len(set(keys.tolist())) == len(keys) and (keys[:3] < 0).all() and (keys[3:5] >= 0).all()


def test_pairs_of_packed_sets(spark):
    docs = spark.createDataFrame([(i, f"a b c {'d ' * (i % 5)}\ne f {'g' if i % 3 else '7'}", "en", "s") for i in range(40)], "doc_id long, text string, lang string, source string")
    want = {tuple(r) for r in dice_pairs(text_units(docs), 0.5).collect()}
    assert want and {tuple(r) for r in dice_pairs(text_units(docs, packed=True), 0.5).collect()} == want


def test_lines_are_packed_and_ranked_rows_are_dropped(spark):
    from kindred.sources.tabular import text_sub_units

    docs = spark.createDataFrame([(i, "a b c d e\n\nf g a 7 8 9 f", "en", "s") for i in range(9)], "doc_id long, text string, lang string, source string")
    dropped = []
    scratch = Scratch(spark, "t")
    scratch.drop = lambda *tables, drop=scratch.drop: (dropped.extend(t._scratch_path for t in tables), drop(*tables))
    packed = {r.unit_id: unpack_sets(_binary(r.packed_keys))[0].tolist() for r in text_sub_units(docs, scratch, packed=True).collect()}
    assert packed == {r.unit_id: sorted(r.body_keys) for r in text_sub_units(docs, Scratch(spark, "t")).collect()} and len(packed) == 18
    assert [p for p in dropped if p.endswith("-rows")]


def test_a_cell_is_judged_in_little_more_room_than_its_counts():
    import tracemalloc

    from kindred.operators.near import _passes

    rng = np.random.default_rng(3)
    n = 500
    held = rng.random((2, n, 900)) < np.linspace(0.3, 0.001, 900)
    keyed = [cells._distinct(np.nonzero(x.T)[0], np.nonzero(x.T)[1]) for x in held]
    sides = [{"body_count": x.sum(1)} for x in held]
    want = held[0].astype(int) @ held[1].T.astype(int)
    shared = cells.shared_keys(keyed[0], n, keyed[1], n)
    assert (shared == want).all()
    total = sides[0]["body_count"][:, None] + sides[1]["body_count"]
    for threshold in (-1.0, 0.0, 0.25, 0.5, 1.0):
        i, j = np.nonzero(2.0 * want / total >= threshold)
        got = [np.concatenate(x) for x in zip(*_passes(*sides, shared, False, threshold), strict=True)]
        assert got[0].tolist() == i.tolist() and got[1].tolist() == j.tolist() and (got[2] == (2.0 * want / total)[i, j]).all()
    tracemalloc.start()
    list(_passes(*sides, shared, False, 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * n * 8


def test_counts_of_a_cell_take_four_bytes_and_their_pairs_come_in_small_parts():
    import tracemalloc

    rng = np.random.default_rng(4)
    n = 400
    held = rng.random((2, n, 6000)) < 0.03
    keyed = [cells._distinct(np.nonzero(x.T)[0], np.nonzero(x.T)[1].astype(np.uint16)) for x in held]
    tracemalloc.start()
    shared = cells.shared_keys(keyed[0], n, keyed[1], n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pairs = int((held[0].sum(0) * held[1].sum(0)).sum())
    assert shared.tolist() == (held[0].astype(int) @ held[1].T.astype(int)).tolist()
    assert shared.dtype == np.int32 and peak < 8 * pairs


def test_a_cell_whose_pairs_all_pass_takes_little_room(monkeypatch):
    import tracemalloc

    from kindred.operators import near

    monkeypatch.setattr(near, "JUDGED", 1 << 14, raising=False)
    n = 600
    sides = [{"unit_id": np.arange(k * n, (k + 1) * n), "body_count": np.full(n, 10)} for k in range(2)]
    shared = np.full((n, n), 9, np.int32)
    shared[n - 1, n - 1] = 6
    tracemalloc.start()
    got = near._linking(0.5)(*sides, shared, False).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [{"a": 0, "b": x, "score": 0.6} for x in range(1, 2 * n)]
    assert peak < 8 * n * n
    assert near._passing(0.5)(*sides, shared, False).num_rows == n * n
    alone = near._linking(0.5)(sides[0], sides[0], shared, True).to_pylist()
    assert [(r["a"], r["b"]) for r in alone] == [(0, x) for x in range(1, n)]


def test_keys_of_two_blocks_meet_without_being_sorted_again():
    import tracemalloc

    n = 200_000
    one, two = (np.arange(k, 2 * n + k, 2) for k in range(2))
    two[:50] = one[:50]
    keyed = [(keys, np.ones(n, np.int64), np.arange(n) % 5) for keys in (one, two)]
    tracemalloc.start()
    shared = cells.shared_keys(keyed[0], 5, keyed[1], 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert shared.tolist() == (10 * np.eye(5, dtype=int)).tolist()
    assert peak < 6 * 8 * n
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert not cells.shared_keys(keyed[0], 5, nothing, 2).any() and not cells.shared_keys(nothing, 2, keyed[0], 5).any()


def test_a_batch_holds_one_cell(spark, monkeypatch):
    def rows_of_batches(judge, columns):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"a": [batch.num_rows], "b": [0], "score": [1.0]})

        return run

    monkeypatch.setattr(cells, "SETS", 5)
    monkeypatch.setattr(cells, "_cells", rows_of_batches)
    got = near_links(frame(spark, *[unit(i, range(10), n=25) for i in range(60)]), 0.5, Scratch(spark, "t")).collect()
    assert len(got) > 1 and {r.a for r in got} == {1}
