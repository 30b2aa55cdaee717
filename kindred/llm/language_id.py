"""Language identification by Bayesian fusion of text, declared language, address suffix and host priors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from ..scratch import Scratch
from ..shipping import ship
from .url_filter import split_url, suffix_and_domain

SLOTS = 1 << 14  # hashed byte trigrams of the text model
UNITS = 10**6  # posteriors are summed as whole numbers of this part, so sums do not depend on their order
_OPENING = re.compile(r"<(?:(script|style|noscript|template)\b|!--)", re.I | re.A)
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I | re.A) for name in ("script", "style", "noscript", "template")} | {None: re.compile("-->")}
_TAG = re.compile(r"<[^>]*>")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9A-Fa-f]+|\w+);")
_HTML = re.compile(r"<html\b", re.I | re.A)
_LANG = re.compile(r"""\blang\s*=\s*(?:["']\s*)?([a-z]{2,3})\b""", re.I | re.A)


def trigram_slots(data: np.ndarray) -> np.ndarray:
    """Slot of each byte trigram, A-Z lower-cased and other than letters taken as blanks."""
    if len(data) < 3:
        return np.empty(0, np.int64)
    low = V.lower_ascii(data)
    low = np.where((low >= 97) & (low <= 122) | (low >= 128), low, 32).astype(np.uint32)
    code = low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]
    return (((code * np.uint32(2654435761)) >> np.uint32(18))[code != 0x202020]).astype(np.int64)


def _trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in V.slices(batches, "text"):
        data, offsets = V.text_bytes(batch.column("text"))
        total: dict[str, np.ndarray] = {}
        for lang, a, b in zip(batch.column("lang").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            total.setdefault(lang, []).append(data[a:b])
        for lang, parts in total.items():
            counts = sum(np.bincount(trigram_slots(p), minlength=SLOTS) for p in parts)
            slot = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot, pa.int32()), pa.array(counts[slot], pa.int64())], names=["lang", "slot", "c"])


def train_text_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5, max_languages: int = 256) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-likelihoods, one row of SLOTS each, from all labelled rows.

    Rows with a null text or language teach nothing; empty texts only name their language; repeated rows count as often
    as they occur; texts of any length are read whole; an empty table gives an empty model.  Counts are combined in each
    task and by grouped aggregation; languages times SLOTS sums reach the driver, so a table of more than
    ``max_languages`` languages is an error: such a column must be cleaned first.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    if rows.select("lang").distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    ship(labelled.sparkSession)
    sums = rows.mapInArrow(_trigram_counts, "lang string, slot int, c long").groupBy("lang", "slot").agg(F.sum("c").alias("c")).groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("c").alias("counts")).orderBy("lang").collect()
    table = np.full((len(sums), SLOTS), smoothing)
    for i, row in enumerate(sums):
        table[i, row.slots] += row.counts
    return [r.lang for r in sums], np.log(table / table.sum(axis=1, keepdims=True))


def _without_hidden(html: str) -> str:
    """Comments and elements that are never shown, each as a blank; those that are not closed stay."""
    parts, at, look, missing = [], 0, 0, set()
    while opening := _OPENING.search(html, look):
        name = opening[1] and opening[1].lower()
        closing = None if name in missing else _CLOSING[name].search(html, opening.end())
        if closing is None:  # nor is there one further on
            missing.add(name)
            look = opening.end()
        else:
            parts += [html[at : opening.start()], " "]
            at = look = closing.end()
    return "".join([*parts, html[at:]])


def visible_text(html: str) -> str:
    """What remains without hidden elements, tags and entities, in time linear in the length of any input."""
    html = _without_hidden(html)
    last = html.rfind(">") + 1  # no tag ends behind it
    return _ENTITY.sub(" ", _TAG.sub(" ", html[:last]) + html[last:])


def declared_language(html: str) -> str | None:
    """``lang`` of the first html tag, its first two or three letters in lower case."""
    tag = _HTML.search(html)
    if not tag:
        return None
    end = html.find(">", tag.end())
    found = _LANG.search(html, tag.end(), end if end >= 0 else len(html))
    return found[1].lower() if found else None


def _evidence(model: np.ndarray, weight: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.slices(batches, "html"):
            likelihood, declared = [], []
            for html in batch.column("html").to_pylist():
                declared.append(declared_language(html or ""))
                slots = trigram_slots(np.frombuffer(visible_text(html or "").encode(), np.uint8))
                score = model[:, slots].sum(axis=1) * weight
                likelihood.append((score - score.max()).tolist() if len(score) else [])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(declared, pa.string()), pa.array(likelihood, pa.list_(pa.float64()))], names=["page_id", "url", "declared", "text_ll"])

    return run


def _softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    powers = [F.exp(s - top) for s in scores]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def identify_language(pages: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_weight: float = 0.1, strength: float = 5.0) -> DataFrame:
    """(page_id, host, declared, lang, probability, text_lang) of each page.

    Evidence is combined as log-odds: the text under the model, damped by ``text_weight`` since trigrams overlap; the
    language that the markup declares; the address suffix; and the prior of the host.  The likelihoods of the last
    three are learned from all pages: each page counts with its text-only posterior, grouped by declared language, by
    suffix, and by host, registered domain and everything; a host's shares are shrunk towards its domain's and those
    towards the overall ones with the weight of ``strength`` pages, leaving out the page that is judged.  Null and
    empty html has no text evidence, null urls belong to the empty host, a missing declaration is a value of its own.
    Rows with a null id and repeated rows are judged like any other; of equally likely languages the first by name wins;
    html of any length is read whole, in linear time; other columns are ignored, whatever their names; no pages or an
    empty model give no rows.  ``probability`` is rounded to nine places; posteriors are summed in whole UNITS, so
    reruns agree.
    """
    languages, table = model
    spark = pages.sparkSession
    scratch = Scratch(spark, "language")
    schema = "page_id long, url string, declared string, text_ll array<double>"
    if not languages:
        return spark.createDataFrame([], "page_id long, host string, declared string, lang string, probability double, text_lang string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    seen = rows.mapInArrow(_evidence(table, text_weight), schema)
    host, _ = split_url(F.col("url"))
    every = range(len(languages))
    q = [f"q{i}" for i in every]
    text = [F.col("text_ll")[i] for i in every]
    seen = seen.select("page_id", host.alias("host"), F.coalesce("declared", F.lit("")).alias("declared"), "text_ll", *[F.round(p * UNITS).cast("long").alias(n) for p, n in zip(_softmax(text), q, strict=True)])
    seen = scratch.write(seen, "evidence")

    sums = [F.sum(c).alias(c) for c in q]
    of_all = seen.agg(F.count("*").alias("n"), *sums).first()
    base = [(of_all[c] or 0) / UNITS / of_all.n if of_all.n else 0.0 for c in q]
    base = [(b + 1e-6) / (1 + 1e-6 * len(q)) for b in base]

    def shrunk(own: list[Column], n: Column, above: list[Column]) -> list[Column]:
        return [(o / F.lit(float(UNITS)) + strength * a) / (n + strength) for o, a in zip(own, above, strict=True)]

    def likelihood(df: DataFrame, prefix: str) -> DataFrame:
        """log P(value | language) up to a term that is the same for all languages."""
        posterior = shrunk([F.col(c) for c in q], F.col("n"), [F.lit(b) for b in base])
        return df.select("*", *[F.log(p / base[i]).alias(f"{prefix}{i}") for i, p in enumerate(posterior)])

    said = seen.groupBy("declared").agg(F.count("*").alias("n"), *sums)
    said = scratch.write(likelihood(said, "d").select("declared", *[f"d{i}" for i in every]), "declared")
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = seen.groupBy("host").agg(F.count("*").alias("n"), *sums).withColumn("suffix", suffix).withColumn("domain", domain)
    hosts = scratch.write(hosts, "host-counts")
    ends = likelihood(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), *sums), "s").select("suffix", *[f"s{i}" for i in every])
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), *[F.sum(c).alias(f"d{c}") for c in q])
    hosts = hosts.join(domains, ["suffix", "domain"]).join(ends, "suffix")
    hosts = scratch.write(hosts.select("host", "n", "dn", *[F.col(c).alias(f"h{c}") for c in q], *[f"d{c}" for c in q], *[f"s{i}" for i in every]), "hosts")

    joined = seen.join(hosts, "host").join(said, "declared")
    less = lambda p: [F.greatest(F.col(f"{p}{c}") - F.col(c), F.lit(0)) for c in q]
    above = shrunk(less("d"), F.col("dn") - 1, [F.lit(b) for b in base])
    prior = shrunk(less("h"), F.col("n") - 1, above)
    scores = [text[i] + F.col(f"d{i}") + F.col(f"s{i}") + F.log(prior[i]) for i in every]
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-i).alias("i")) for i, p in enumerate(_softmax(scores))]))
    own = F.array_max(F.array(*[F.struct(F.col(c).alias("p"), F.lit(-i).alias("i")) for i, c in enumerate(q)]))
    name = lambda at: F.element_at(F.array(*[F.lit(x) for x in languages]), 1 - at)
    out = joined.withColumn("best", best)
    return out.select("page_id", "host", F.nullif("declared", F.lit("")).alias("declared"), name(F.col("best.i")).alias("lang"), F.round("best.p", 9).alias("probability"), name(own["i"]).alias("text_lang"))
