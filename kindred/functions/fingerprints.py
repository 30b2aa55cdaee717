"""Fingerprints as columns: 16 lower-case hex digits, ordered like the numbers they show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(canonical: Column) -> Column:
    return F.substring(F.md5(canonical), 1, 16)


def node_token(disc: Column, data: Column, n_children: Column) -> Column:
    return F.concat(disc, F.lit(":"), data, F.lit(":"), n_children.cast("string"))


def composite(fingerprint_col: str) -> Column:
    """Aggregate: one fingerprint for a group, from the exact sum of its members' and their number.

    Independent of order, repeated fingerprints count, and partial sums are combined before any shuffle.
    """
    total = F.sum(F.conv(fingerprint_col, 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    return fingerprint(F.concat_ws(",", F.count("*").cast("string"), total.cast("string")))


def parse_hex(text: Column) -> Column:
    """Canonical form of a hex number of up to 64 bits, with any case, sign ``+`` and zeros; null if it is none."""
    digits = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), "^0+(?=.)", "")
    return F.when(F.regexp_like(text, F.lit("^[+]?0*[0-9A-Fa-f]{1,16}$")), F.lpad(F.lower(digits), 16, "0"))


def valid_hex(text: str) -> str | None:
    """The same for one string."""
    import re

    return text.removeprefix("+").lstrip("0").lower().rjust(16, "0") if re.fullmatch(r"\+?0*[0-9A-Fa-f]{1,16}", text) else None
