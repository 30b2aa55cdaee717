"""Long texts and words, sizes at the edge of a threshold, hashes that must differ, clashing columns, real tables."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import language_id as LID
from kindred.llm import queries
from kindred.llm import vectors as V
from kindred.llm.encoding import encoder, tokenizer_path
from kindred.llm.exact_dedup import exact_dedup
from kindred.llm.mixing import mix_sources
from kindred.llm.ngram_join import first_hits, ngram_join
from kindred.llm.packing import pack
from kindred.llm.quality_rules import quality_rules
from kindred.llm.substring_dedup import _in_pairs, substring_dedup
from kindred.llm.token_counts import length_histogram
from kindred.llm.url_filter import suffix_and_domain, url_filter

from . import brute
from .corpus import corpus, frame

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("share", [1, 2, 5, 20, 50])
@pytest.mark.parametrize("percent", [1, 30, 50, 60, 80, 90, 95, 99, 100])
def test_first_hits_are_guaranteed(percent, share):
    """Of any two sizes that can link, both prefixes hold at least what either document is asked for."""
    n = np.arange(1, 700)
    asked = dict(zip(n.tolist(), first_hits(n, percent, share).tolist(), strict=True))
    need = lambda x: -(-x * percent // 100)
    ell = lambda x: min(1 + x // share, need(x))
    for a in range(1, 700, 1 + (percent < 80) * 6):
        for b in range(need(a), a + 1):
            if b >= 1:
                overlap = max(-(-percent * (a + b) // (100 + percent)), 1)
                held = min(overlap - need(a) + ell(a), overlap - need(b) + ell(b))
                assert 1 <= asked[a] and asked[a] <= max(held, 1) and asked[b] <= max(held, 1), (a, b)


@pytest.mark.parametrize("percent", [50, 95, 99])
def test_near_sizes_link(spark, percent):
    rng = random.Random(percent)
    docs = {}
    for family in range(24):
        words = [f"f{family}w{i}" for i in range(4 + rng.choice([19, 20, 99, 100, 101, 200, 40]))]
        docs[len(docs)] = " ".join(words)
        docs[len(docs)] = " ".join(words[1:] if family % 2 else words[:-1])
        docs[len(docs)] = " ".join(words[: len(words) * 3 // 4])
    want = brute.near_components(docs, percent)
    assert len({c for _, c in want.values()}) < len(docs) - 10
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(frame(spark, docs), percent=percent).collect()} == want


def thue_morse(n):
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def hashes(texts, seed=0):
    data, offsets = V.text_bytes(pa.array(texts))
    starts, ends, _ = V.word_spans(data, offsets)
    return V.hash_spans(data, starts, ends, seed).tolist()


def test_words_that_a_polynomial_would_confuse():
    for n in (8, 64, 65, 1024, 4096, 1 << 16):
        one, two = thue_morse(n)
        assert len(set(hashes([one, two]))) == 2 and not set(hashes([one, two])) & set(hashes([one, two], 1))
    rng = random.Random(3)
    words = {"".join(rng.choice("ab\x01é") for _ in range(rng.randint(1, 90))) for _ in range(5000)}
    assert len(set(hashes(sorted(words)))) == len(words)
    zeros = ["\x00" * k for k in range(1, 80)]
    assert len(set(hashes(zeros))) == len(zeros)


def test_pairs_are_looked_up_as_pairs():
    known = np.array([1, 1, 2, 5]), np.array([7, 9, 8, 7])
    assert _in_pairs(np.array([1, 1, 1, 2, 2, 3, 5]), np.array([7, 9, 8, 8, 7, 7, 9]), *known).tolist() == [True, True, False, True, False, False, False]


def long_documents():
    rng = random.Random(11)
    words = [f"w{rng.randrange(60_000)}" for _ in range(800_000)]
    one, two = thue_morse(1 << 20)
    tm, complement = thue_morse(2048)
    frame_of = lambda w: " ".join(["x"] * 6 + [w] + [f"y{i}" for i in range(6)])
    return {0: " ".join(words), 1: "start " + " ".join(words[5:]), 2: one, 3: two, 4: one + " " + one, 5: frame_of(tm), 6: frame_of(complement), 7: frame_of(tm), 8: "\n" * 10**6, 9: "é\n" * 30_000, 10: None}


def test_long_texts_and_words_in_every_operator(spark):
    docs = long_documents()
    df = frame(spark, docs).repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(df).collect()} == brute.near_components(docs)
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(df).collect()} == brute.exact(docs)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df).collect()} == brute.substrings(docs)
    judged = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(df).collect()}
    assert judged == {i: brute.quality(t) for i, t in docs.items()}
    want = brute.mixture([(r.doc_id, r.text, r.source) for r in df.collect()])
    assert {r.doc_id: (r.size, r.copies) for r in mix_sources(df).collect()} == {i: (w[0], w[3]) for i, w in want.items()}


def test_long_texts_are_encoded_whole(spark):
    docs = {0: "word and more, " * 150_000, 1: "ab" * 100_000, 2: "x"}
    lengths = {i: len(x) // 2 + 1 for i, x in zip(docs, encoder(tokenizer_path()).encode(list(docs.values())), strict=True)}
    pieces = defaultdict(int)
    for r in pack(frame(spark, docs), tokenizer_path()).collect():
        pieces[r.doc_id] += r.length
    assert pieces == lengths
    assert sorted((r.n_tokens, r.n_docs) for r in length_histogram(frame(spark, docs), tokenizer_path()).collect()) == sorted((n - 1, 1) for n in lengths.values())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'stream.,1aZé–’\u00a0\u2003\u0301<|endoftext|>")), max_size=60))
def test_encoder_equals_the_library_on_any_text(text):
    e = encoder(tokenizer_path())
    assert e.encode([text])[0] == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, e.id_type).tobytes()


def test_exact_dedup_without_a_bitmap(spark):
    docs = corpus(1) | {1000: "", 1002: "x" * 500 + "a", 1003: "x" * 500 + "b", 1004: "x" * 500 + "a"}
    rows = [sorted(map(tuple, exact_dedup(frame(spark, docs), most_bits=m, all_hashes=True).collect())) for m in (1 << 28, 0)]
    assert rows[0] == rows[1] and {r[0]: (r[1], r[2]) for r in rows[0]} == brute.exact(docs) and all(r[4] for r in rows[0])


def test_exact_dedup_of_rows_without_an_id(spark):
    rows = [(None, "a"), (None, "a"), (1, "a"), (None, "b"), (2, "c"), (2, "c"), (2, "d"), (None, None), (None, "")]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(None, 1, 3, False): 2, (1, 1, 3, True): 1, (None, None, 1, True): 1, (2, 2, 2, True): 2, (2, 2, 1, True): 1, (None, None, 2, True): 2})


def test_offsets_are_random(spark):
    """Over seeds, every document's copies average to its rate; the operator equals the plain version for a seed."""
    docs = [(i, "w " * (i + 1), "ab"[i % 2]) for i in range(40)]
    total, seeds = Counter(), 400
    for seed in range(seeds):
        for i, (_, source_size, target, copies) in brute.mixture(docs, seed).items():
            total[i] += copies - target / source_size
    assert all(abs(x) / seeds < 0.1 for x in total.values())
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for seed in (0, 17):
        assert {r.doc_id: r.copies for r in mix_sources(df, seed=seed).collect()} == {i: w[3] for i, w in brute.mixture(docs, seed).items()}


def test_words_taken_come_near_the_target(spark):
    rows = queries.op8_mixing(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("longest")).collect():
        assert abs(r.taken - r.target) < 2 * r.longest


def test_verdicts_of_hosts_on_the_tables(spark):
    """Some verdicts on the driver's tables come from the posterior, of either kind."""
    verdicts = {(r.verdict) for r in queries.op3_url_filter(spark, SF).where("rule is null").select("verdict").distinct().collect()}
    assert verdicts == {"allow", "block"}
    judged = {(r.host_verdict, r.kept) for r in queries.op5_quality_rules(spark, SF).where("borderline").select("host_verdict", "kept").distinct().collect()}
    assert judged == {("strict", False), ("lenient", True)}


def test_outcomes_count_once_however_often_a_page_repeats(spark):
    pages = spark.createDataFrame([(i, f"x://h{i % 3}.net/") for i in range(30)] * 2 + [(None, None), (None, None)], "page_id long, url string")
    bad = spark.createDataFrame([(i, i % 3 == 0) for i in range(30)], "page_id long, bad boolean")
    rows = url_filter(pages, bad, ()).collect()
    assert len(rows) == 62 and {r.n_outcomes for r in rows if r.host} == {10} and {r.verdict for r in rows if r.host == "h0.net"} == {"block"}


def test_html_is_read_in_linear_time():
    for part in ("<script>", "<!--", "<", "<html ", "<script></script ", "&a", "<html lang=" + " " * 50, "lang", "<style><script>", "</script"):
        text = part * (10**6 // len(part))
        began = time.time()
        LID.visible_text(text)
        LID.declared_language(text)
        LID.declared_language("<html lang=" + " " * 10**6)
        assert time.time() - began < 2, part
    assert LID.visible_text("a<script>x</SCRIPT >b<!-- <p> -->c<style>d<p>e&amp;f<") == "a b c d e f<"
    assert LID.visible_text("<SCRIPT>x<style>y</script>z</style>") == " z "
    assert [LID.declared_language(x) for x in ("<HTML lang='de-AT'>", '<html class=x lang = "en">', "<html><p lang=fr>", "<html", "x")] == ["de", "en", None, None, None]


def test_language_evidence_is_fused_as_stated(spark):
    """All four pieces of evidence, recomputed in plain Python."""
    model = LID.train_text_model(spark.read.parquet(f"{SF}/documents.parquet"))
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(120)
    pages = pages.unionByName(spark.createDataFrame([(None, None, None), (9001, "x://a.b.co.uk/", ""), (9001, "x://a.b.co.uk/", "")], "page_id long, url string, html string"))
    languages, table = model
    strength, seen = 5.0, []
    for r in pages.collect():
        data = np.frombuffer(LID.visible_text(r.html or "").encode(), np.uint8)
        ll = table[:, LID.trigram_slots(data)].sum(axis=1) * 0.1
        e = np.exp(ll - ll.max())
        q = np.array([math.floor(x * 10**6 + 0.5) for x in e / e.sum()], float) / 10**6
        found = re.search(r"://([^/?#]*)", r.url or "")
        host = found[1].lower() if found else ""
        labels = host.split(".")
        two = len(labels) > 2 and ".".join(labels[-2:]) == "co.uk"
        seen.append((r.page_id, host, LID.declared_language(r.html or ""), (".".join(labels[-2:]) if two else labels[-1], ".".join(labels[-3:] if two else labels[-2:])), ll - ll.max(), q))
    base = sum(s[5] for s in seen) / len(seen)
    base = (base + 1e-6) / (1 + 1e-6 * len(base))

    def groups(key):
        sums, n = defaultdict(lambda: np.zeros(len(base))), Counter()
        for s in seen:
            sums[key(s)] = sums[key(s)] + s[5]
            n[key(s)] += 1
        return sums, n

    keys = {"said": lambda s: s[2], "suffix": lambda s: s[3][0], "domain": lambda s: s[3], "host": lambda s: s[1]}
    sums = {name: groups(key) for name, key in keys.items()}
    likelihood = lambda name, s: np.log((sums[name][0][keys[name](s)] + strength * base) / (sums[name][1][keys[name](s)] + strength) / base)
    want = Counter()
    for s in seen:
        above, prior = base, None
        for name in ("domain", "host"):
            total, n = sums[name][0][keys[name](s)], sums[name][1][keys[name](s)]
            prior = (np.maximum(total - s[5], 0) + strength * above) / (n - 1 + strength)
            above = prior
        score = s[4] + likelihood("said", s) + likelihood("suffix", s) + np.log(prior)
        p = np.exp(score - score.max())
        p /= p.sum()
        want[s[0], s[1], s[2], languages[int(p.argmax())], round(float(p.max()), 6), languages[int(s[5].argmax())]] += 1
    got = Counter((r.page_id, r.host, r.declared, r.lang, round(r.probability, 6), r.text_lang) for r in LID.identify_language(pages, model).collect())
    assert got == want


def test_columns_with_names_used_inside(spark):
    extra = [F.lit(1).alias(c) for c in ("host", "path", "bad", "n", "k", "suffix", "domain", "declared", "lang", "q0", "bucket", "text_ll")]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    bad = spark.createDataFrame([(1, True), (2, False)], "page_id long, bad boolean")
    assert sorted(url_filter(pages.select("*", *extra), bad.withColumn("host", F.lit("x")), ()).collect()) == sorted(url_filter(pages, bad, ()).collect())
    model = LID.train_text_model(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert sorted(LID.identify_language(pages.select("*", *extra), model).collect()) == sorted(LID.identify_language(pages, model).collect())
    docs = frame(spark, corpus(5, 40)).select("doc_id", "text", "lang", "source", "n_chars")
    names = ("copies", "copy", "size", "target", "kept", "component_id", "rank", "Copies_")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.select("*", *[F.lit(7).alias(c) for c in names]), "")
        assert out.columns == [*docs.columns, *names] and all(r[c] == 7 for r in out.collect() for c in names)
        assert Counter(map(tuple, out.select(*docs.columns).collect())) == Counter(map(tuple, stage(spark, docs, "").collect()))
    assert pack(docs.select("*", F.lit(1).alias("part"), F.lit(2).alias("ids")), tokenizer_path()).count() == pack(docs, tokenizer_path()).count()


def test_too_many_languages_are_an_error(spark):
    rows = spark.range(300).select(F.lit("a b c").alias("text"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"))
    with pytest.raises(ValueError, match="languages"):
        LID.train_text_model(rows)


def test_suffix_of_odd_hosts(spark):
    hosts = ["", "localhost", "a.co.uk", "co.uk", "x.y.a.co.uk", "..", "a."]
    s, d = suffix_and_domain(F.col("h"))
    got = {r.h: (r.s, r.d) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", s.alias("s"), d.alias("d")).collect()}
    assert got["a.co.uk"] == ("co.uk", "a.co.uk") and got["x.y.a.co.uk"] == ("co.uk", "a.co.uk") and got["localhost"] == ("localhost", "localhost") and got[""] == ("", "")
