"""One query for each operator, over the driver's tables.

The tables hold no source code, so documents and orders stand in for it: see sources.tabular for their trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import samples
from .config import Config, apply_overrides, config_of
from .errors import CheckFailed, KindredError
from .functions.fingerprints import composite, parse_hex
from .operators.exact import exact_members, gathered, live_fingerprints, ordinals
from .operators.ignore import drop_ignored, ignore_frame, live_entries, stale_entries, upsert
from .operators.near import bucket_sizes, dice_pairs, first_occurrence_rank, near_candidates, near_components, near_links, near_members
from .operators.stats import check_limits, rollup, stats
from .report import REPORTERS, group_json, member_lines, stats_json
from .schema import SOURCE_FILES
from .scratch import Scratch
from .sources.files import extension, has_extension, is_excluded, language_of
from .sources.tabular import line_nodes, order_units, text_nodes, text_sub_units, text_units

THRESHOLD = 0.5  # of text trees: enough pairs pass to tell right from wrong
ORDER_THRESHOLD = 0.9
SUB_THRESHOLD = 0.8


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(spark, d, **kw):
    return text_units(_t(spark, d, "documents"), _t(spark, d, "labels"), **kw)


def _kept_texts(spark, d, with_keys=True):
    """Text units, computed once for plans that read them several times."""
    scratch = Scratch(spark, "text-units")
    return scratch.write(_texts(spark, d, with_keys=with_keys, packed=with_keys), "units"), scratch


def _lines(spark, d, scratch=None, with_keys=True):
    return text_sub_units(_t(spark, d, "documents"), scratch or Scratch(spark, "line-units"), with_keys=with_keys, packed=with_keys)


def _kept_lines(spark, d, with_keys=True):
    scratch = Scratch(spark, "line-units")
    return scratch.write(_lines(spark, d, scratch, with_keys), "units"), scratch


def _unit_columns(units):
    return units.select("unit_id", "kind", "name", "file", "line_start", "line_end", "fingerprint", "node_count", "body_count", "is_test")


def scan_exclude_paths(spark, d):
    """Pages as files: wanted extensions that no exclude pattern matches."""
    pages = _t(spark, d, "pages").select("page_id", "url", extension(F.col("url")).alias("ext"))
    return pages.where(has_extension(F.col("url"), ["html", "com"]) & ~is_excluded(F.col("url"), ["/de/", "blog."]))


def language_counts(spark, d):
    return _t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("files"))


LISTINGS = {"rust": ("src/lib.rs", "README.md", "src/A.RS"), "python": ("a.py", "b.pyi", "Makefile"), "both": ("x/a.py", "x/b.rs"), "neither": ("a.txt", ".py", "rs"), "empty": ()}


def language_detect(spark, d):
    """The language of each listing of files, or why there is none."""

    def outcome(files):
        try:
            return language_of(files)
        except KindredError as e:
            return type(e).__name__

    return spark.createDataFrame([(name, outcome(files)) for name, files in LISTINGS.items()], "name string, outcome string")


def units_text(spark, d):
    return _unit_columns(_texts(spark, d, min_nodes=10, min_lines=2, with_keys=False))


def units_orders(spark, d):
    return order_units(_t(spark, d, "lineitem")).select("unit_id", "fingerprint", "node_count", "line_end")


def text_tree_nodes(spark, d):
    """Nodes of each tree in preorder, summed up to one row a document and depth."""
    nodes = text_nodes(_t(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text"))
    return nodes.groupBy("unit_id", "depth").agg(F.count("*").alias("nodes"), F.sum("pos").alias("pos_sum"), F.sum("parent").alias("parent_sum"), F.sum("child_idx").alias("child_sum"), F.sum("n_children").alias("children"))


def placeholder_index(spark, d):
    """First-occurrence rank of roles inside a conversation."""
    turns = _t(spark, d, "conversations").where("text is not null").select("conv_id", F.lit("Variable").alias("kind"), F.col("role").alias("name"), F.col("turn").alias("pos"))
    return first_occurrence_rank(turns, "conv_id", "kind", "name", "pos").select("conv_id", "name", "first", "index").distinct()


def reindexed_subtree(spark, d):
    nodes = line_nodes(_t(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text"))
    index = F.substring_index("data", "#", -1).cast("int")
    return nodes.groupBy("unit_id", F.col("sub_line").alias("line_no")).agg(F.count("*").alias("nodes"), F.coalesce(F.max(F.when(F.col("disc") == "Placeholder", index)), F.lit(-1)).alias("last_index"), F.sum(F.when(F.col("disc") == "Placeholder", index).otherwise(0)).alias("index_sum"))


def fingerprints(spark, d):
    return _texts(spark, d, with_keys=False).select("unit_id", "fingerprint")


def fingerprint_parse(spark, d):
    keys = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.hex("event_id")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("+00"), F.lower(F.hex("event_id")))).otherwise(F.col("event_type")).alias("text"))
    return keys.select("event_id", parse_hex(F.col("text")).alias("fingerprint"))


def composite_fingerprint(spark, d):
    """One order-independent fingerprint for the documents of each source."""
    rows = _texts(spark, d, with_keys=False).select("fingerprint", F.substring_index("file", "/", 1).alias("source"))
    return rows.groupBy("source").agg(composite("fingerprint").alias("fingerprint"))


def exact_groups_text(spark, d):
    """Groups in order, one row for each member."""
    units, scratch = _kept_texts(spark, d, with_keys=False)
    return ordinals(scratch.write(exact_members(units), "exact"), scratch).select("ordinal", "fingerprint", "similarity", "n_members", "unit_id")


def exact_groups_orders(spark, d):
    """Shapes of orders; a group can hold any number of orders, so members stay rows elsewhere."""
    return order_units(_t(spark, d, "lineitem")).groupBy("fingerprint").agg(F.count("*").alias("n_members"), F.min("unit_id").alias("first_unit")).where("n_members > 1")


def exact_members_text(spark, d):
    return exact_members(_kept_texts(spark, d, with_keys=False)[0]).select("fingerprint", "n_members", "unit_id", "name", "file")


def size_buckets(spark, d):
    return bucket_sizes(near_candidates(_kept_texts(spark, d, with_keys=False)[0]))


def near_candidates_text(spark, d):
    return near_candidates(_kept_texts(spark, d, with_keys=False)[0]).select("unit_id", "fingerprint")


def dice_pairs_text(spark, d):
    return dice_pairs(near_candidates(_kept_texts(spark, d)[0]), THRESHOLD)


def dice_pairs_orders(spark, d):
    scratch = Scratch(spark, "order-units")
    return dice_pairs(near_candidates(scratch.write(order_units(_t(spark, d, "lineitem")), "units")), ORDER_THRESHOLD)


def near_components_text(spark, d):
    units, scratch = _kept_texts(spark, d)
    return near_components(scratch.write(near_links(near_candidates(units), THRESHOLD, scratch), "pairs"), scratch)


def _shown(members):
    return members.select("fingerprint", "similarity", "n_members", "unit_id")


def near_groups_text(spark, d):
    units, scratch = _kept_texts(spark, d)
    return _shown(near_members(units, THRESHOLD, scratch))


def near_members_text(spark, d):
    units, scratch = _kept_texts(spark, d)
    return near_members(units, THRESHOLD, scratch).select("component", "similarity", "unit_id", "name")


def tests_excluded(spark, d):
    return _texts(spark, d, with_keys=False).where("not is_test").select("unit_id", "fingerprint")


def sub_units(spark, d):
    return _lines(spark, d, with_keys=False).select("unit_id", "kind", "name", "file", "fingerprint", "node_count", "parent_name")


def sub_exact_groups(spark, d):
    return _lines(spark, d, with_keys=False).groupBy("fingerprint").agg(F.count("*").alias("n_members"), F.min("unit_id").alias("first_unit")).where("n_members > 1")


def sub_near_groups(spark, d):
    lines, scratch = _kept_lines(spark, d)
    return _shown(near_members(lines, SUB_THRESHOLD, scratch))


def _text_sections(spark, d):
    units, scratch = _kept_texts(spark, d)
    return units, scratch.write(exact_members(units), "exact"), scratch.write(near_members(units, THRESHOLD, scratch).drop("component"), "near"), scratch


def live_fingerprints_text(spark, d):
    _, exact, near, _ = _text_sections(spark, d)
    return live_fingerprints(exact, near)


def _ignored(units):
    """A list made from the data: fingerprints below 4, with reasons by their first digit, and an invalid one."""
    some = units.where("fingerprint < '4'").select("fingerprint").distinct()
    rows = some.select("fingerprint", F.concat(F.lit("starts with "), F.substring("fingerprint", 1, 1)).alias("reason"), F.array().cast("array<string>").alias("members"))
    return rows.unionByName(units.sparkSession.createDataFrame([("no hex", None, [])], rows.schema))


def ignore_filter(spark, d):
    units, exact, near, _ = _text_sections(spark, d)
    sections = exact.withColumn("section", F.lit("exact")).unionByName(near.withColumn("section", F.lit("near")))
    return drop_ignored(sections, _ignored(units)).select("section", "fingerprint", "n_members").distinct()


def ignore_stale(spark, d):
    units, exact, near, _ = _text_sections(spark, d)
    return stale_entries(_ignored(units), live_fingerprints(exact, near)).select("fingerprint", "reason")


def ignore_live(spark, d):
    units, exact, near, _ = _text_sections(spark, d)
    return live_entries(_ignored(units), live_fingerprints(exact, near)).select("fingerprint", "reason")


def ignore_upsert(spark, d):
    units = _kept_texts(spark, d, with_keys=False)[0]
    new = units.where("fingerprint < '8'").select("fingerprint", F.lit("new").alias("reason"), F.array().cast("array<string>").alias("members")).distinct()
    return upsert(_ignored(units), new).select("fingerprint", "reason")


def stats_text(spark, d):
    units, exact, near, _ = _text_sections(spark, d)
    return stats(units, exact, near)


def stats_with_sub(spark, d):
    units, exact, near, scratch = _text_sections(spark, d)
    lines = scratch.write(_lines(spark, d, scratch), "lines")
    return stats(units, exact, near, exact_members(lines), near_members(lines, SUB_THRESHOLD, scratch))


def stats_rollup(spark, d):
    named = _texts(spark, d, with_keys=False).withColumn("test", F.col("is_test").cast("string"))
    return rollup(named, "kind", "test").fillna("all", ["kind", "test"])


def check_limits_text(spark, d):
    return check_limits(stats_text(spark, d), max_exact=1000, max_near=0, max_exact_percent=5.0, max_near_percent=99.0)


def group_ordinals(spark, d):
    units, exact, near, _ = _text_sections(spark, d)
    named = ordinals(exact).withColumn("section", F.lit("exact")).unionByName(ordinals(near).withColumn("section", F.lit("near")))
    return named.select("section", "ordinal", "fingerprint", "n_members", "similarity").distinct()


def report_json_rows(spark, d):
    """Each group as one JSON text, so a group must fit in a row here; the rows of report_text_rows have no such limit."""
    return group_json(gathered(exact_members(_kept_texts(spark, d, with_keys=False)[0])))


def report_json_near(spark, d):
    units, scratch = _kept_texts(spark, d)
    return group_json(gathered(near_members(units, THRESHOLD, scratch)))


def report_text_rows(spark, d):
    units, scratch = _kept_texts(spark, d, with_keys=False)
    return member_lines(scratch.write(exact_members(units), "exact"), "exact").drop("unit_id")


def report_text_near(spark, d):
    units, scratch = _kept_texts(spark, d)
    return member_lines(scratch.write(near_members(units, THRESHOLD, scratch), "near"), "near").drop("unit_id")


def report_text_sub(spark, d):
    """Both sections of sub-units, with parents."""
    lines, scratch = _kept_lines(spark, d)
    exact, near = scratch.write(exact_members(lines), "exact"), scratch.write(near_members(lines, SUB_THRESHOLD, scratch), "near")
    shown = [member_lines(rows, name).withColumn("section", F.lit(name)) for name, rows in (("sub_exact", exact), ("sub_near", near))]
    return shown[0].unionByName(shown[1]).drop("unit_id")


def report_json_stats(spark, d):
    return stats_json(stats_text(spark, d))


CONFIGS = {  # (Cargo.toml, dupes.toml, overrides)
    "defaults": ("", "", {}),
    "metadata": ("[package.metadata.dupes]\nmin_nodes = 15\nexclude = ['a']", "", {}),
    "file over metadata": ("[package.metadata.dupes]\nmin_nodes = 15\nmin_lines = 3", "min_nodes = 25\nsimilarity_threshold = 1\nunknown = 7", {}),
    "overrides": ("", "min_nodes = 25\nexclude = ['x']\nexclude_tests = true", {"min_nodes": 5, "exclude": ["y", "z"], "exclude_tests": False, "similarity_threshold": None}),
    "ill-typed file": ("[package.metadata.dupes]\nmax_exact_duplicates = 2", "min_nodes = 'many'\nmin_lines = 9", {}),
    "malformed files": ("[package", "= 1", {"sub_function": True, "min_sub_nodes": 7}),
}


def config_precedence(spark, d):
    """Layers of settings, later ones first: command line, own file, metadata, defaults."""
    made = {name: apply_overrides(config_of(cargo, own), **given) for name, (cargo, own, given) in CONFIGS.items()}
    rows = [(n, c.min_nodes, c.similarity_threshold, ",".join(c.exclude), c.max_exact_duplicates, c.min_lines, c.exclude_tests, c.sub_function, c.min_sub_nodes) for n, c in made.items()]
    return spark.createDataFrame(rows, "name string, min_nodes long, similarity_threshold double, exclude string, max_exact_duplicates long, min_lines long, exclude_tests boolean, sub_function boolean, min_sub_nodes long")


def _sample_units(spark, analyzer, files):
    from .frontend.registry import extract

    sources = spark.createDataFrame([(i, name, text, None) for i, (name, text) in enumerate(files.items())], SOURCE_FILES)
    columns = ("section", "file", "kind", "name", "line_start", "line_end", "node_count", "fingerprint", "parent_name", "is_test", "warning")
    return extract(sources, analyzer, min_nodes=1, min_sub_nodes=3).select(*columns)


def python_units(spark, d):
    """Units and sub-units of sample sources, as no table holds any."""
    from .frontend.registry import LANGUAGES

    return _sample_units(spark, LANGUAGES["python"], samples.PYTHON)


def rust_units(spark, d):
    from .frontend.registry import LANGUAGES

    return _sample_units(spark, LANGUAGES["rust"], samples.RUST)


def mapped_units(spark, d):
    """A mapped grammar with a tolerant parser and queries that capture units."""
    from .frontend.braces import ANALYZER

    return _sample_units(spark, ANALYZER, samples.BRACES)


def _sample_output(spark, form, command, entries=(), **settings):
    """Lines that a command prints about sample sources."""
    import io
    from argparse import Namespace

    from .cli import print_check, print_report
    from .frontend.registry import LANGUAGES, extract
    from .plans.analyze import analyze_units

    config = Config(similarity_threshold=0.8, min_sub_nodes=8, **settings)
    scratch = Scratch(spark, "sample")
    sources = spark.createDataFrame([(i, name, text, None) for i, (name, text) in enumerate(samples.SIMILAR.items())], SOURCE_FILES)
    rows = scratch.write(extract(sources, LANGUAGES["rust"], config.min_nodes, config.min_lines, config.min_sub_nodes), "units")
    rows = rows.where("not is_test") if config.exclude_tests else rows
    of = lambda section: rows.where(F.col("section") == section).drop("section", "warning")
    result, out = analyze_units(of("unit"), config, of("sub"), ignore_frame(spark, list(entries))), io.StringIO()
    reporter = REPORTERS[form]("/project")
    try:
        if command == "report":
            print_report(result, reporter, out)
        else:
            print_check(result, reporter, config, Namespace(max_exact=None, max_near=0, max_exact_percent=10.0, max_near_percent=None), out)
    except CheckFailed as e:
        print(f"Error: {e}", file=out)
    return spark.createDataFrame(list(enumerate(out.getvalue().split("\n"), 1)), "line_no long, line string")


def sample_report_text(spark, d):
    return _sample_output(spark, "text", "report", sub_function=True)


def sample_report_json(spark, d):
    return _sample_output(spark, "json", "report", sub_function=True, exclude_tests=True)


def sample_check(spark, d):
    """Limits from the configuration and the command line; the exact group is ignored."""
    return _sample_output(spark, "text", "check", [{"fingerprint": samples.IGNORED}], max_exact_duplicates=0)


ALL = (
    scan_exclude_paths, language_counts, language_detect, units_text, units_orders, text_tree_nodes, placeholder_index, reindexed_subtree, fingerprints, fingerprint_parse, composite_fingerprint,
    exact_groups_text, exact_groups_orders, exact_members_text, size_buckets, near_candidates_text, dice_pairs_text, dice_pairs_orders, near_components_text, near_groups_text, near_members_text, tests_excluded,
    sub_units, sub_exact_groups, sub_near_groups, live_fingerprints_text, ignore_filter, ignore_stale, ignore_live, ignore_upsert, stats_text, stats_with_sub, stats_rollup, check_limits_text, group_ordinals,
    report_json_rows, report_json_near, report_json_stats, report_text_rows, report_text_near, report_text_sub, config_precedence, python_units, rust_units, mapped_units, sample_report_text, sample_report_json, sample_check,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}
