"""Structural duplicate analytics on Spark DataFrames."""

from __future__ import annotations

import importlib

# where the public names live; loaded when they are first used, so workers import only what they run
_PUBLIC = {
    "Analysis": "plans.analyze", "analyze_files": "plans.analyze", "analyze_path": "plans.analyze", "analyze_units": "plans.analyze",
    "Config": "config", "load_config": "config", "apply_overrides": "config",
    "Analyzer": "frontend.registry", "LANGUAGES": "frontend.registry", "extract": "frontend.registry", "parse_file": "frontend.registry", "parse_files": "frontend.registry", "register_udtfs": "frontend.registry",
    "Cst": "frontend.mapping", "Grammar": "frontend.mapping", "mapped_analyzer": "frontend.mapping", "parse_queries": "frontend.captures",
    "detect_language": "sources.files", "read_sources": "sources.files", "scan_files": "sources.files",
    "exact_groups": "operators.exact", "exact_members": "operators.exact", "live_fingerprints": "operators.exact", "ordinals": "operators.exact",
    "dice_pairs": "operators.near", "near_candidates": "operators.near", "near_components": "operators.near", "near_groups": "operators.near",
    "drop_ignored": "operators.ignore", "ignore_frame": "operators.ignore", "live_entries": "operators.ignore", "load_entries": "operators.ignore", "save_entries": "operators.ignore", "stale_entries": "operators.ignore",
    "check_limits": "operators.stats", "stats": "operators.stats",
    "JsonReporter": "report", "Reporter": "report", "TextReporter": "report",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str):
    if name in _PUBLIC:
        return getattr(importlib.import_module(f"{__name__}.{_PUBLIC[name]}"), name)
    raise AttributeError(name)
