"""Every link of the n-gram join, against all pairs."""

from __future__ import annotations

import random

import pytest

from kindred.operators import cells
from kindred.llm.ngram_join import ngram_join, ngram_links

from . import brute
from .corpus import corpus, frame


def all_links(docs, percent=80):
    """{(a, b)} of ids, a < b."""
    sets = {i: brute.shingles(t) for i, t in docs.items()}
    ids = sorted(i for i, s in sets.items() if s)
    shared = lambda a, b: len(sets[a] & sets[b])
    return {(a, b): n for k, a in enumerate(ids) for b in ids[k + 1 :] if (n := shared(a, b)) and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)}


def near_group(n, seed=5):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(70)]
    docs = {}
    for i in range(n):
        near = list(base)
        for _ in range(rng.choice([0, 1, 2, 2, 3])):
            near[rng.randrange(70)] = f"x{rng.randrange(5000)}"
        docs[i] = " ".join(near)
    return docs


def compare(spark, docs, percent=80):
    want = all_links(docs, percent)
    rows = ngram_join(frame(spark, docs), percent=percent, links=True).collect()
    counts = dict.fromkeys(docs, 0)
    for a, b in want:
        counts[a] += 1
        counts[b] += 1
    assert {r.doc_id: r.n_links for r in rows} == counts and len(rows) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_components(docs, percent)
    of = {r.doc_id: r.class_id for r in rows}
    between = sorted((a, b, n) for (a, b), n in want.items() if of[a] == a and of[b] == b)
    assert sorted(map(tuple, ngram_links(frame(spark, docs), percent=percent).collect())) == between
    return want


def test_links_of_a_group_of_near_copies(spark):
    docs = near_group(150)
    assert len(compare(spark, docs)) > 10 * len(docs)


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_links_of_a_corpus_in_small_blocks(spark, monkeypatch, percent):
    monkeypatch.setattr(cells, "SETS", 7)
    compare(spark, corpus(3), percent)


def test_links_across_bands_and_of_repeated_rows(spark):
    words = [f"w{i}" for i in range(400)]
    docs = {i: " ".join(words[: 40 + 3 * i]) for i in range(100)} | {200: None, 201: "", 202: "w1 w2", 203: "w1 w2"}
    compare(spark, docs)
    twice = ngram_join(frame(spark, docs).unionByName(frame(spark, docs)), links=True).collect()
    once = {tuple(r) for r in ngram_join(frame(spark, docs), links=True).collect()}
    assert len(twice) == 2 * len(once) and set(map(tuple, twice)) == once
