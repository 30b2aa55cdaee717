"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when their sets of word n-grams have a Jaccard similarity of at least ``percent``/100.  If
sets r and s link, they share at least ``o = ceil(t|r|)`` n-grams, so under any one order of all n-grams the first
``|r| - o + l`` of r and the first ``|s| - o + l`` of s share at least l.  Documents differ in l: the prefix of a
document is lengthened while that lowers its estimated cost, and a pair must then share ``min(l_r, l_s)`` of its
prefix n-grams before it is verified.  Nothing is approximate: every bound is a necessary condition.

Passes, each over tables in the shared folder:

1. One scan makes each document's n-gram set, a 128-bit key of the set and a prefix in hash order with
   ``l = 1 + n/20``.  Only documents with enough prefix n-grams that occur elsewhere (``first_hits``) can have a partner.
2. Survivors, one per distinct set, are ordered by document frequency among survivors (rarest first).  N-grams
   of a single survivor cannot be shared; documents with fewer than ``o`` others are out.
3. Each prefix n-gram's documents are compared with one pivot, the document whose n-grams are the most frequent.
   That is linear in the index and joins large groups of near copies at once.
4. Documents of one n-gram that are still in different components are joined on it, leaving out pairs inside
   the n-gram's largest component.  The multi-match test runs inside that join, on prefixes that travel with the lists,
   so only pairs that pass it are rows; they fetch their sets for verification.
5. On demand, every link.  Both ends of a link lie in one component, so the pairs of each component are judged
   block by block (``ngram_links.py``); passes 3 and 4 alone see enough links for components, but not all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_links as L
from . import vectors as V
from ..operators.components import components
from ..scratch import Scratch

_SET = "doc_id long, n long, key binary, least int, pre array<long>"


def _sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size of each row and the sorted distinct n-gram hashes of all rows, one row after the other."""
    data, offsets = V.text_bytes(batch.column("text"))
    data = V.lower_ascii(data)
    starts, ends, rows = V.word_spans(data, offsets)
    words = V.hash_spans(data, starts, ends)
    at, gram = V.grams(words, rows, width)
    row = rows[at]
    counts = np.bincount(rows, minlength=batch.num_rows)
    if (few := (counts > 0) & (counts < width)).any():
        mine = few[rows]
        row = np.concatenate([row, np.flatnonzero(few)])
        gram = np.concatenate([gram, V.whole_rows(words[mine], rows[mine], batch.num_rows)[few]])
    gram = gram.view(np.int64)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    if len(row):
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
        row, gram = row[new], gram[new]
    return np.bincount(row, minlength=batch.num_rows), gram


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def first_hits(n: np.ndarray, percent: int, share: int) -> np.ndarray:
    """How many n-grams of a document's first prefix its partners have too, at least; n: distinct set sizes.

    Both prefixes hold the pair's first ``min(o - need(n) + l(n), o - need(m) + l(m))`` shared n-grams, o being the overlap
    that sizes n and m need.  Larger partners allow l(n); a smaller one may allow less, so the least over all sizes that
    can link counts.  From some size on that is l(n) again, since o then exceeds need(m) by more than l may differ.
    """
    need = lambda x: _needed(x, percent)
    ell = lambda x: np.minimum(1 + x // share, need(x))
    t = percent / 100
    if t * t * share < 1 + t:
        return np.minimum(n, 1)
    out = ell(n)
    small = (n > 0) & (n * t * (1 - t) < 3 * (1 + t)) if percent < 100 else np.zeros(len(n), bool)  # equal sets: n = m
    for i in np.flatnonzero(small):
        m = np.arange(need(n[i]), n[i] + 1)
        overlap = -(-percent * (n[i] + m) // (100 + percent))
        out[i] = np.minimum(out[i], overlap - need(m) + ell(m)).min()
    return np.maximum(out, np.minimum(n, 1))


def _first_pass(width: int, percent: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(batches, "text"):
            n, gram = _sets(batch, width)
            ends = np.cumsum(n)
            starts = ends - n
            keys = [xxhash.xxh3_128_digest(gram[a:b].data) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            need = _needed(n, percent)
            take = np.where(n > 0, n - need + np.minimum(1 + n // share, need), 0)
            rank = np.arange(len(gram)) - np.repeat(starts, n)
            sizes, of = np.unique(n, return_inverse=True)
            least = first_hits(sizes, percent, share)[of]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(least, pa.int32()), V.lists(take, gram[rank < np.repeat(take, n)])], names=["doc_id", "n", "key", "least", "pre"])

    return run


def _survivor_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(batches, "text"):
            n, gram = _sets(batch, width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), V.lists(n, gram)], names=["rep", "n", "grams"])

    return run


def _adapt(percent: int, longest: int):
    """Order a document's shared n-grams and choose its l, from 1 to ``longest``.

    Cost of l: scanning the lists of its prefix, ``S = sum(df)``, plus verifying the candidates left.  At most
    ``S / l`` documents can meet l times in lists of S entries, and verifying one costs about its own length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for rep, n, pairs in zip(*(batch.column(c) for c in ("rep", "n", "shared")), strict=True):
                df, gram = (pairs.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                rep, n = rep.as_py(), n.as_py()
                order = np.lexsort((gram, df))
                df, gram, alone, need = df[order], gram[order], n - len(df), int(_needed(np.array(n), percent))
                first = n - need + 1 - alone  # shared n-grams in the prefix for l = 1
                reach = np.cumsum(df)[first - 1 :]  # for l = 1, 2, ...
                ell = np.arange(1, min(need, len(reach), longest) + 1)
                cost = reach[: len(ell)] * (1 + n / ell)
                best = int(ell[np.argmin(cost)])
                kept.append((rep, n, len(df), float(df.sum() / n), best, first, first + best - 1, gram))
            yield pa.RecordBatch.from_pylist([dict(zip(("rep", "n", "v", "central", "ell", "first", "reach", "grams"), x, strict=True)) for x in kept], schema=_ADAPTED)

    return run


_ADAPTED = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("v", pa.int64()), ("central", pa.float64()), ("ell", pa.int32()), ("first", pa.int32()), ("reach", pa.int32()), ("grams", pa.list_(pa.int64()))])
_ADAPTED_DDL = "rep long, n long, v long, central double, ell int, first int, reach int, grams array<long>"


def _feasible(a: str, b: str, percent: int) -> str:
    """Sizes, and n-grams that are shared with anyone, allow the overlap that the pair needs."""
    return f"least({a}.v, {b}.v) * {100 + percent} >= {percent} * ({a}.n + {b}.n)"


def _multi_match(a: str, b: str, percent: int, held: str) -> str:
    """The prefixes share as many n-grams as the smaller l asks for, and as many as the pair's overlap needs.

    Of two prefixes, that which ends first in the common order holds every shared n-gram up to its end, and behind it
    its document has ``v - reach`` more.
    """
    need = f"ceil({percent} * ({a}.n + {b}.n) / {100 + percent}) - greatest({a}.v - {a}.reach, {b}.v - {b}.reach)"
    return f"size(array_intersect(slice({a}.{held}, 1, {a}.reach), slice({b}.{held}, 1, {b}.reach))) >= greatest(least({a}.ell, {b}.ell), {need})"


def _verified(a: str, b: str, percent: int) -> str:
    return f"size(array_intersect({a}.grams, {b}.grams)) * {100 + percent} >= {percent} * ({a}.n + {b}.n)"


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, share: int, longest: int, members: bool) -> tuple[Scratch, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Passes 1 to 4: the scratch folder, (doc_id, n, key, pre), (key, class_id) with the class's ``members`` if
    asked for, the index of survivors and (node, component) of linked classes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")

    first = scratch.write(docs.mapInArrow(_first_pass(width, percent, share), _SET), "sets")
    classes = scratch.write(first.groupBy("key").agg(F.min("doc_id").alias("class_id"), *[F.countDistinct("doc_id").alias("members")] * members), "classes")
    entries = first.select(F.explode("pre").alias("gram"), "doc_id")
    elsewhere = scratch.write(entries.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1").select("gram"), "elsewhere")
    hits = entries.join(elsewhere.hint("shuffle_hash"), "gram").groupBy("doc_id").agg(F.count("*").alias("hits"))
    alive = first.select("doc_id", "least").join(hits, "doc_id").where("hits >= least").select("doc_id")
    alive = scratch.write(alive.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id").select("doc_id").distinct(), "alive")
    scratch.drop(elsewhere)

    sets = scratch.write(docs.join(alive.hint("shuffle_hash"), "doc_id").mapInArrow(_survivor_sets(width), "rep long, n long, grams array<long>"), "survivors")
    entries = sets.select(F.explode("grams").alias("gram"), "rep", "n")
    df = scratch.write(entries.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    shared = entries.join(df.hint("shuffle_hash"), "gram").groupBy("rep").agg(F.max("n").alias("n"), F.collect_set(F.struct("df", "gram")).alias("shared"))
    index = scratch.write(shared.where(f"size(shared) * 100 >= {percent} * n").mapInArrow(_adapt(percent, longest), _ADAPTED_DDL), "index")
    scratch.drop(alive, sets, df)

    posted = index.select(F.explode(F.expr("slice(grams, 1, first)")).alias("gram"), "rep", "central")
    pivots = scratch.write(posted.groupBy("gram").agg(F.max(F.struct("central", "rep")).alias("p")).select("gram", F.col("p.rep").alias("pivot")), "pivots")
    pairs = posted.join(pivots, "gram").where("rep <> pivot").select("rep", "pivot").distinct()
    a, b = index.alias("a"), index.alias("b")
    met = pairs.alias("p").join(a, F.expr("p.rep = a.rep")).join(b, F.expr("p.pivot = b.rep"))
    links = scratch.write(met.where(_feasible("a", "b", percent)).where(_multi_match("a", "b", percent, "grams")).where(_verified("a", "b", percent)).select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v")), "pivot-links")
    parts = scratch.write(components(links, scratch), "pivot-components")

    member = index.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component", "central")
    member = scratch.write(member, "members")
    posted = member.select(F.explode(F.expr("slice(grams, 1, first)")).alias("gram"), "rep", "part")
    sides = posted.groupBy("gram", "part").agg(F.count("*").alias("c"))
    largest = scratch.write(sides.groupBy("gram").agg(F.max(F.struct("c", "part")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("gram", F.col("m.part").alias("most")), "open-grams")
    # only prefixes travel with the lists; the smaller sides ask, everyone answers
    held = member.withColumn("pre", F.expr("slice(grams, 1, reach)")).drop("grams")
    open_ = scratch.write(posted.drop("part").join(largest, "gram").join(held, "rep"), "open-lists")
    a, b = open_.where("part <> most").alias("a"), open_.alias("b")
    first_met = "try_element_at(array_intersect(slice(a.pre, 1, a.first), slice(b.pre, 1, b.first)), 1) = a.gram"
    met = F.expr(f"a.gram = b.gram AND a.part <> b.part AND (b.part = b.most OR a.rep < b.rep) AND {_feasible('a', 'b', percent)} AND {first_met} AND {_multi_match('a', 'b', percent, 'pre')}")
    pairs = scratch.write(a.join(b, met).select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v")).distinct(), "open-pairs")
    a, b = index.alias("a"), index.alias("b")
    more = pairs.alias("p").join(a, F.expr("p.u = a.rep")).join(b, F.expr("p.v = b.rep")).where(_verified("a", "b", percent)).select("p.u", "p.v")
    more = scratch.write(more, "more-links")
    if more.limit(1).count():
        parts = scratch.write(components(links.unionByName(more), scratch), "components")
    scratch.drop(pivots, member, largest, open_, pairs)
    return scratch, first, classes, index, parts


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, share: int = 20, longest: int = 32, links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id): the components of all links of at least ``percent``.

    docs: any table with a unique integer id and a text; other columns are ignored, whatever their names.  A-Z are
    lower-cased.  A document of fewer than ``width`` words has one n-gram, its whole sequence; null, empty and blank
    texts have none, link with nothing and are their own component; texts and words of any length are read whole.  ``class_id`` is the smallest id with the same
    n-gram set: equal sets link, so a class is judged once, through that member.  Rows with a null id are left out;
    repeated rows come out as often as they go in; an empty table gives no rows.  ``share``: a document is looked at in pass 2 if it has one prefix n-gram in
    common with others for each ``share`` of its n-grams, plus one.  ``longest``: the most that l may be.
    ``links`` adds ``n_links``, the exact number of other ids that the document links with, those of its class included.
    """
    scratch, first, classes, index, parts = _components(docs, id_col, text_col, width, percent, share, longest, links)
    of = first.select("doc_id", "n", "key").join(classes, "key")
    own = []
    if links:
        counts = L.links(index, parts, classes, percent, scratch, False).groupBy(F.col("rep").alias("class_id")).agg(F.sum("n_links").alias("n_links"))
        of = of.join(scratch.write(counts, "link-counts"), "class_id", "left")
        own = [F.when(F.col("n") > 0, F.coalesce("n_links", F.lit(0)) + F.col("members") - 1).otherwise(0).cast("long").alias("n_links")]
    scratch.drop(index)
    return of.join(parts.withColumnRenamed("node", "class_id"), "class_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "class_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), *own)


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, share: int = 20, longest: int = 32) -> DataFrame:
    """(u, v, shared): every link between classes of ngram_join, u < v their ``class_id``, and how many n-grams they share.

    Within a class all texts link and are not listed.  There may be as many rows as pairs in a group of near copies.
    """
    scratch, _, classes, index, parts = _components(docs, id_col, text_col, width, percent, share, longest, True)
    out = scratch.write(L.links(index, parts, classes, percent, scratch, True), "links")
    scratch.drop(index)
    return out
