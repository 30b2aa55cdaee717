"""The analysis: units to groups, ignore list and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import NoSourceFiles
from ..frontend.registry import Analyzer, extract
from ..operators.exact import exact_members, live_fingerprints
from ..operators.ignore import drop_ignored, ignore_frame, load_entries
from ..operators.near import near_members
from ..operators.stats import stats
from ..scratch import Scratch
from ..sources.files import read_sources, scan_files


@dataclass
class Analysis:
    """Frames of one analysis.  Sections hold a row for each member of the groups that the ignore list leaves; ``live``
    holds all fingerprints before it."""

    units: DataFrame
    exact: DataFrame
    near: DataFrame
    sub_exact: DataFrame | None
    sub_near: DataFrame | None
    live: DataFrame
    warnings: list[str]

    @cached_property
    def stats(self) -> DataFrame:
        return stats(self.units, self.exact, self.near, self.sub_exact, self.sub_near)


def analyze_units(units: DataFrame, config: Config, sub_units: DataFrame | None = None, ignore: DataFrame | None = None, warnings: Sequence[str] = ()) -> Analysis:
    """Groups of any frame with the columns of schema.UNITS.

    Ignoring comes last: an exact group that is ignored does not come back as a near one.  Sections are written to the
    shared folder, since statistics, reports and clean-up all read them.
    """
    spark = units.sparkSession
    scratch = Scratch(spark, "analysis")
    if ignore is None:
        ignore = ignore_frame(spark, load_entries(config.root))
    threshold = config.similarity_threshold
    sections = {"exact": scratch.write(exact_members(units), "exact"), "near": scratch.write(near_members(units, threshold, scratch), "near")}
    if config.sub_function and sub_units is not None:
        sections |= {"sub_exact": scratch.write(exact_members(sub_units), "sub-exact"), "sub_near": scratch.write(near_members(sub_units, threshold, scratch), "sub-near")}
    live = live_fingerprints(*sections.values())
    left = {name: drop_ignored(groups, ignore) for name, groups in sections.items()}
    return Analysis(units, left["exact"], left["near"], left.get("sub_exact"), left.get("sub_near"), live, list(warnings))


def analyze_files(spark: SparkSession, files: Sequence[str], analyzer: Analyzer, config: Config) -> Analysis:
    """Parse files once, keep the rows, and analyze them; bad files are warnings."""
    scratch = Scratch(spark, "extraction")
    sources = scratch.write(read_sources(spark, files), "sources")
    rows = scratch.write(extract(sources, analyzer, config.min_nodes, config.min_lines, config.min_sub_nodes if config.sub_function else None), "units")
    failed = [r[0] for r in sources.where("read_error is not null").orderBy("file_no").select("read_error").collect()]
    failed += [r[0] for r in rows.where("section = 'warning'").select("warning").orderBy("warning").collect()]
    kept = rows.where(~F.col("is_test")) if config.exclude_tests else rows
    columns = [c for c in rows.columns if c not in ("section", "warning")]
    return analyze_units(kept.where("section = 'unit'").select(*columns), config, kept.where("section = 'sub'").select(*columns), warnings=failed)


def analyze_path(spark: SparkSession, root: str | Path, analyzer: Analyzer, config: Config) -> Analysis:
    files = scan_files(root, config.exclude, analyzer.extensions)
    if not files:
        raise NoSourceFiles(root)
    return analyze_files(spark, files, analyzer, config)
