"""Command line: stats, report, check, ignore, ignored, cleanup."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession

from .config import Config, apply_overrides, load_config
from .errors import CheckFailed, InvalidFingerprint, KindredError
from .frontend.registry import LANGUAGES
from .functions.fingerprints import valid_hex
from .operators.ignore import add_entry, entry_line, ignore_frame, live_entries, load_entries, save_entries, stale_entries
from .plans.analyze import Analysis, analyze_path
from .report import REPORTERS
from .sources.files import detect_language


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kindred", description="Find structural duplicates in source code.")
    common = argparse.ArgumentParser(add_help=False)
    for target, default in ((p, None), (common, argparse.SUPPRESS)):
        add = lambda *names, target=target, default=default, **kw: target.add_argument(*names, **({"default": default} | kw))
        add("-p", "--path", type=Path, help="what to analyze; the current directory")
        add("-l", "--language", choices=sorted(LANGUAGES))
        add("--min-nodes", type=int)
        add("--min-lines", type=int)
        add("--threshold", type=float, help="similarity from 0 to 1")
        add("--format", choices=sorted(REPORTERS), **({"default": "text"} if default is None else {}))
        add("--exclude", action="append", help="part of a path; can be repeated")
        add("--exclude-tests", action="store_true", **({"default": False} if default is None else {}))
        add("-s", "--sub-function", action="store_true", **({"default": False} if default is None else {}))
        add("--min-sub-nodes", type=int)
    sub = p.add_subparsers(dest="command")
    sub.add_parser("stats", parents=[common])
    sub.add_parser("report", parents=[common])
    check = sub.add_parser("check", parents=[common])
    for name, kind in (("--max-exact", int), ("--max-near", int), ("--max-exact-percent", float), ("--max-near-percent", float)):
        check.add_argument(name, type=kind)
    ignore = sub.add_parser("ignore", parents=[common])
    ignore.add_argument("fingerprint")
    ignore.add_argument("--reason")
    sub.add_parser("ignored", parents=[common])
    sub.add_parser("cleanup", parents=[common]).add_argument("--dry-run", action="store_true")
    return p


def run_analysis(spark: SparkSession, root: Path, config: Config, language: str | None) -> Analysis:
    return analyze_path(spark, root, LANGUAGES[language or detect_language(root)], config)


def print_report(result: Analysis, reporter, out: TextIO) -> None:
    reporter.stats(result.stats.first(), out)
    print(file=out)
    reporter.groups("exact", result.exact, out)
    for section in ("near", "sub_exact", "sub_near"):
        groups = getattr(result, section)
        if groups is not None and not groups.isEmpty():
            reporter.groups(section, groups, out)


def print_check(result: Analysis, reporter, config: Config, args: argparse.Namespace, out: TextIO) -> None:
    row = result.stats.first()
    reporter.stats(row, out)
    pick = lambda given, own: own if given is None else given
    counts = (("exact", pick(args.max_exact, config.max_exact_duplicates), row.exact_duplicate_groups), ("near", pick(args.max_near, config.max_near_duplicates), row.near_duplicate_groups))
    shares = (("exact", pick(args.max_exact_percent, config.max_exact_percent), row.exact_duplicate_percent), ("near", pick(args.max_near_percent, config.max_near_percent), row.near_duplicate_percent))
    failed = False
    for section, most, actual in counts:
        if most is not None and actual > most:
            failed = True
            print(f"\nCheck FAILED: {actual} {section} duplicate groups (max: {most})", file=out)
            reporter.groups(section, getattr(result, section), out)
    for section, most, actual in shares:
        if most is not None and actual > most:
            failed = True
            print(f"\nCheck FAILED: {actual:.1f}% {section} duplicate lines (max: {most:.1f}%)", file=out)
            reporter.groups(section, getattr(result, section), out)
    if failed:
        raise CheckFailed
    print("\nCheck passed.", file=out)


def _ignore(root: Path, args: argparse.Namespace, out: TextIO) -> None:
    fingerprint = valid_hex(args.fingerprint)
    if fingerprint is None:
        raise InvalidFingerprint(args.fingerprint)
    save_entries(root, add_entry(load_entries(root), fingerprint, args.reason))
    print(f"Added {fingerprint} to ignore list.", file=out)


def _ignored(root: Path, out: TextIO) -> None:
    entries = load_entries(root)
    print("Ignored fingerprints:" if entries else "No ignored fingerprints.", file=out)
    for e in entries:
        print(entry_line(e), file=out)


def _cleanup(spark: SparkSession, root: Path, result: Analysis, dry_run: bool, out: TextIO) -> None:
    entries = load_entries(root)
    frame = ignore_frame(spark, entries)
    stale = {r.fingerprint for r in stale_entries(frame, result.live).collect()}
    gone = [e for e in entries if e["fingerprint"] in stale]
    if not gone:
        print("No stale entries found.", file=out)
        return
    if not dry_run:
        live = {r.fingerprint for r in live_entries(frame, result.live).collect()}
        save_entries(root, [e for e in entries if e["fingerprint"] in live])
    print("Stale entries (dry run):" if dry_run else "Removed stale entries:", file=out)
    for e in gone:
        print(entry_line(e), file=out)
    print(f"\n{len(gone)} stale entries would be removed." if dry_run else f"\nRemoved {len(gone)} stale entries.", file=out)


def run(argv: Sequence[str], spark: SparkSession | None = None, out: TextIO | None = None, err: TextIO | None = None) -> int:
    """Exit code: 0, 1 for a failed check, 2 for any other error."""
    out, err = out or sys.stdout, err or sys.stderr
    args = parser().parse_args(list(argv))
    root = args.path or Path.cwd()
    try:
        if args.command == "ignore":
            _ignore(root, args, out)
            return 0
        if args.command == "ignored":
            _ignored(root, out)
            return 0
        flags = {"exclude_tests": args.exclude_tests or None, "sub_function": args.sub_function or None}
        config = apply_overrides(load_config(root), min_nodes=args.min_nodes, min_lines=args.min_lines, similarity_threshold=args.threshold, exclude=args.exclude, min_sub_nodes=args.min_sub_nodes, **flags)
        language = args.language or detect_language(root)
        spark = spark or SparkSession.builder.appName("kindred").getOrCreate()
        result = run_analysis(spark, root, config, language)
        for w in result.warnings:
            print(f"Warning: {w}", file=err)
        reporter = REPORTERS[args.format](str(root))
        if args.command == "stats":
            reporter.stats(result.stats.first(), out)
        elif args.command == "check":
            print_check(result, reporter, config, args, out)
        elif args.command == "cleanup":
            _cleanup(spark, root, result, args.dry_run, out)
        else:
            print_report(result, reporter, out)
    except (KindredError, OSError) as e:
        print(f"Error: {e}", file=err)
        return getattr(e, "exit_code", 2)
    return 0


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
