"""Groups, pairs, components, ignore list and statistics as DataFrames."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kindred.functions.fingerprints import composite, parse_hex, valid_hex
from kindred.functions.similarity import size_bucket
from kindred.operators import cells, near
from kindred.operators.components import components
from kindred.operators.exact import exact_groups, exact_members, live_fingerprints, ordinals
from kindred.operators.ignore import drop_ignored, ignore_frame, live_entries, stale_entries, upsert, without
from kindred.operators.near import bucket_pairs, dice_pairs, index_pairs, near_candidates, near_groups, prefix_index
from kindred.operators.stats import check_limits, stats
from kindred.schema import UNITS
from kindred.scratch import Scratch


def unit(i, keys, fp=None, kind="function", n=None, lines=(1, 5)):
    return (i, kind, f"u{i}", "f.py", *lines, fp or f"{i:016x}", len(keys) if n is None else n, len(keys), list(keys), None, False)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), UNITS)


def test_exact_groups_and_order(spark):
    u = frame(spark, unit(1, [1], "b" * 16), unit(2, [1], "b" * 16, kind="class"), unit(3, [2], "a" * 16), unit(4, [2], "a" * 16), unit(5, [3]), unit(6, [1], "c" * 16), unit(7, [1], "c" * 16), unit(8, [1], "c" * 16))
    got = ordinals(exact_groups(u)).orderBy("ordinal").collect()
    assert [(r.fingerprint[0], r.n_members, [m.unit_id for m in r.members], r.similarity) for r in got] == [("c", 3, [6, 7, 8], 1.0), ("a", 2, [3, 4], 1.0), ("b", 2, [1, 2], 1.0)]
    assert exact_members(u).count() == 7
    assert [r.unit_id for r in near_candidates(u).collect()] == [5]


def test_no_units(spark):
    u = frame(spark)
    assert exact_groups(u).count() == 0
    assert near_groups(u, 0.9, Scratch(spark, "t")).count() == 0
    row = stats(u, exact_members(u), exact_members(u)).first()
    assert row.total_code_units == 0 and row.exact_duplicate_percent == 0.0


def test_size_buckets(spark):
    got = spark.range(0, 70).select("id", size_bucket(F.col("id")).alias("b")).collect()
    assert all(r.b == (int(r.id).bit_length() - 1 if r.id else 0) for r in got)


@pytest.mark.parametrize(("threshold", "cell_pairs"), [(0.3, 0), (0.6, 64), (0.8, 0), (0.9, 64), (1.0, 0), (0.0, 64), (-1.0, 64), (1.5, 64)])
def test_prefix_join_equals_all_pairs(spark, monkeypatch, threshold, cell_pairs):
    monkeypatch.setattr(near, "KEY_PAIRS", 0)
    monkeypatch.setattr(near, "CELL_PAIRS", cell_pairs)
    monkeypatch.setattr(cells, "SETS", 9)
    rng = random.Random(int(threshold * 10))
    rows = []
    for i in range(70):
        base = set(rng.sample(range(12), rng.randint(0, 9)))
        rows.append(unit(i, sorted(base), kind=rng.choice(["function", "class"])))
    u = frame(spark, *rows)
    want = set()
    for a, b in itertools.combinations(rows, 2):
        total = a[8] + b[8]
        score = 2.0 * len(set(a[9]) & set(b[9])) / total if total else 1.0
        if a[1] == b[1] and max(a[7].bit_length(), 1) == max(b[7].bit_length(), 1) and score >= threshold:
            want.add((a[0], b[0], score))
    assert {tuple(r) for r in dice_pairs(u, threshold).collect()} == want
    assert {tuple(r) for r in bucket_pairs(u, threshold).collect()} == want
    if 0 < threshold <= 1:
        filled = {x for x in want if rows[x[0]][8]}
        assert {tuple(r) for r in index_pairs(prefix_index(u, threshold), threshold).collect()} == filled


def test_near_group_takes_the_least_passing_score(spark):
    a, b, c = unit(1, range(10), n=12), unit(2, range(1, 11), n=12), unit(3, range(2, 12), n=12)
    (g,) = near_groups(frame(spark, a, b, c), 0.85, Scratch(spark, "t")).collect()
    assert (g.n_members, g.similarity) == (3, 0.9)
    assert near_groups(frame(spark, a, b, c), 0.95, Scratch(spark, "t")).count() == 0


def test_bucket_edges_are_never_compared(spark):
    assert dice_pairs(frame(spark, unit(1, range(15), n=15), unit(2, range(16), n=16)), 0.5).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 201 + i) for i in range(25)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)


def test_hex_forms(spark):
    texts = ["AB", "+0x1", "+00ab", "", "g", "0", "00000000000000000000ff", "12345678901234567", "ffffffffffffffff", "-1", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_hex(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in rows} == {t: (None if t is None else valid_hex(t)) for t in texts}
    assert valid_hex("+00AB") == "00000000000000ab" and valid_hex("12345678901234567") is None


def test_composite_ignores_order_and_counts_repeats(spark):
    f = lambda *x: spark.createDataFrame([(i,) for i in x], "fp string").agg(composite("fp")).first()[0]
    assert f("a" * 16, "b" * 16) == f("b" * 16, "a" * 16) != f("a" * 16, "b" * 16, "b" * 16) and f("f" * 16, "f" * 16) != f("0" * 16)


def test_ignore_list(spark):
    groups = exact_groups(frame(spark, unit(1, [1], "a" * 16), unit(2, [1], "a" * 16), unit(3, [1], "b" * 16), unit(4, [1], "b" * 16)))
    entries = [{"fingerprint": "A" * 16, "reason": "x"}, {"fingerprint": "b" * 16}, {"fingerprint": "nonsense"}, {"fingerprint": "deadbeefdeadbeef"}]
    ignore, live = ignore_frame(spark, entries), live_fingerprints(groups)
    assert [g.fingerprint for g in drop_ignored(groups, ignore).collect()] == ["a" * 16]
    assert {r.fingerprint for r in stale_entries(ignore, live).collect()} == {"nonsense", "deadbeefdeadbeef"}
    assert {r.fingerprint for r in live_entries(ignore, live).collect()} == {"A" * 16, "b" * 16}
    new = ignore_frame(spark, [{"fingerprint": "b" * 16, "reason": "again"}, {"fingerprint": "c" * 16}])
    assert {(r.fingerprint, r.reason) for r in upsert(ignore, new).collect()} == {("A" * 16, "x"), ("b" * 16, None), ("nonsense", None), ("deadbeefdeadbeef", None), ("c" * 16, None)}
    assert without(ignore, "nonsense").count() == 3


def test_stats_and_limits(spark):
    u = frame(spark, unit(1, [1], "a" * 16), unit(2, [1], "a" * 16, lines=(6, 10)), unit(3, range(10), lines=(11, 20)), unit(4, range(20, 30), lines=(30, 29)))
    exact = exact_members(u)
    near = exact.where("false")
    row = stats(u, exact, near, exact, near).first()
    assert (row.total_code_units, row.total_lines, row.exact_duplicate_groups, row.exact_duplicate_units, row.exact_duplicate_lines) == (4, 21, 1, 2, 10)
    assert row.exact_duplicate_percent == 10 / 21 * 100.0 and (row.sub_exact_groups, row.sub_exact_units, row.sub_near_groups) == (1, 2, 0)
    limits = {r.limit_name: r.failed for r in check_limits(stats(u, exact, near), max_exact=1, max_near=0, max_exact_percent=10.0).collect()}
    assert limits == {"max_exact": False, "max_near": False, "max_exact_percent": True}
    assert check_limits(stats(u, exact, near)).count() == 0
