"""Exact duplicates: units with equal fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MEMBER_FIELDS
from ..scratch import Scratch
from .ranks import with_rank


def member() -> F.Column:
    return F.struct(*MEMBER_FIELDS)


def exact_sizes(units: DataFrame) -> DataFrame:
    """(fingerprint, n_members) of groups of more than one; counts are combined before the shuffle."""
    return units.groupBy("fingerprint").agg(F.count("*").alias("n_members")).where("n_members > 1")


def exact_members(units: DataFrame) -> DataFrame:
    """One row for each member of a group: (fingerprint, similarity, n_members, member fields).

    Nothing is gathered: a group may have any size, and the join can be split.
    """
    rows = units.select("fingerprint", *MEMBER_FIELDS).join(exact_sizes(units), "fingerprint")
    return rows.select("fingerprint", F.lit(1.0).alias("similarity"), "n_members", *MEMBER_FIELDS)


def gathered(members: DataFrame) -> DataFrame:
    """(fingerprint, similarity, n_members, members) of member rows, members by unit id: whole groups in one row each,
    for who wants a group as one value."""
    return members.groupBy("fingerprint").agg(F.first("similarity").alias("similarity"), F.first("n_members").alias("n_members"), F.array_sort(F.collect_list(member())).alias("members"))


def exact_groups(units: DataFrame) -> DataFrame:
    return gathered(exact_members(units))


def ordinals(groups: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Adds ``ordinal``: larger groups first, then the more similar, then by fingerprint.  One row or many for a group.

    Only the three columns that decide are sorted, once for each group and in range partitions.
    """
    scratch = scratch or Scratch(groups.sparkSession, "ordinals")
    order = [F.desc("n_members"), F.desc("similarity"), F.asc("fingerprint")]
    ranks = with_rank(groups.select("fingerprint", "n_members", "similarity").distinct(), order, "rank", scratch)
    return groups.join(ranks.select("fingerprint", (F.col("rank") + 1).alias("ordinal")), "fingerprint").select(*groups.columns, "ordinal")


def live_fingerprints(*groups: DataFrame) -> DataFrame:
    """Distinct fingerprints of all sections, before anything is ignored."""
    out = groups[0].select("fingerprint")
    for g in groups[1:]:
        out = out.union(g.select("fingerprint"))
    return out.distinct()
