"""URL filters: address rules, and a hierarchical empirical-Bayes reputation of hosts.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .bayes import bound, fit_beta, shrunk

# Public suffixes of two labels that registries sell under.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "net.au", "org.au", "org.uk")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and for urls without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.

    A rule ``host/path`` fits its host, subdomains included, where the path starts with its own.  Of equally long
    rules the one with the longer host wins.  The list is a parameter, folded into one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        name, slash, start = text.partition("/")
        name = name.lower()
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Public suffix and registered domain of a host; the host itself where it has too few labels."""
    labels = F.split(host, r"\.")
    last_two = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    two = (F.size(labels) > 2) & last_two.isin(*TWO_LABEL_SUFFIXES)
    last = F.try_element_at(labels, F.lit(-1))
    three = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3))
    return F.when(two, last_two).otherwise(last), F.when(two, three).otherwise(last_two)


def host_reputation(hosts: DataFrame, outcomes: DataFrame, scratch: Scratch, z: float = 0.25) -> tuple[DataFrame, float]:
    """(host, n, bad_rate_bound) for each row of hosts(host) from outcomes(host, bad boolean), and the mean of the prior.

    Counts at each level are shrunk towards the level above: all outcomes, then public suffix, registered domain
    and host, with one concentration for each level, fitted by moments.  A host without outcomes has its domain's
    rate.  The bound lies ``z`` posterior standard deviations below the posterior mean.
    """
    tree = hosts.select("host", *[c.alias(n) for c, n in zip(suffix_and_domain(F.col("host")), ("suffix", "domain"), strict=True)])
    counted = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.count_if("bad").alias("k"))
    level = scratch.write(tree.join(counted, "host", "left").fillna(0, ["n", "k"]), "host-counts")
    middle = scratch.write(level.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domain-counts")
    above = middle.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    k, n = F.col("k"), F.col("n")
    mean, weight = fit_beta(above)
    suffixes = above.select("suffix", shrunk(k, n, mean, weight).alias("suffix_rate"))
    _, weight = fit_beta(middle)
    domains = middle.join(suffixes, "suffix").select("suffix", "domain", shrunk(k, n, F.col("suffix_rate"), weight).alias("domain_rate"))
    _, weight = fit_beta(level)
    return level.join(domains, ["suffix", "domain"]).select("host", "n", bound(k, n, F.col("domain_rate"), weight, -z).alias("bad_rate_bound")), mean


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", max_bad_rate: float | None = None, z: float = 0.25) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_outcomes, bad_rate_bound) for each page.

    outcomes: (page_id, bad boolean) of labelled pages; null labels and unknown pages are ignored, and an outcome counts
    once for each host that rows of its page id name, however often they repeat.  The verdict is that of the longest
    fitting rule, otherwise ``block`` where the lower posterior bound of the host's bad rate is above ``max_bad_rate``,
    else ``allow``.  Without a limit it is the mean of the fitted prior: with ``z`` of 0.25 a host goes if it is worse than
    the table's pages with a probability of about 0.6.  Hosts without outcomes pass unless their domain is bad.  Null
    urls and urls without ``://`` have an empty host and path, no rule, and the reputation of the empty host.  Urls of
    any length are read whole; rows with a null id and repeated rows come out as often as they go in; other columns are
    ignored, whatever their names; no pages give no rows.

    Only (id, url) are read.  Hosts are counted with map-side combining and judged once each; judgements return by
    a join on the host, whose large keys Spark can split.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    host, path = split_url(F.col(url_col))
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    named = pages.select("page_id", "host").distinct()
    labelled = outcomes.select(F.col("page_id").cast("long"), "bad").where("bad is not null").join(named, "page_id").select("host", "bad")
    known, mean = host_reputation(pages.select("host").distinct(), labelled, scratch, z)
    known, limit = scratch.write(known, "hosts"), mean if max_bad_rate is None else max_bad_rate
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_rate_bound") > limit, "block").otherwise("allow")
    out = pages.join(known, "host", "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("n").alias("n_outcomes"), "bad_rate_bound")
