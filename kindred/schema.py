"""Schemas of the engine's tables.  They are declared, never inferred."""

from __future__ import annotations

SOURCE_FILES = "file_no long, file string, content string, read_error string"
UNITS = "unit_id long, kind string, name string, file string, line_start int, line_end int, fingerprint string, node_count int, body_count int, body_keys array<long>, parent_name string, is_test boolean"
NODE = "pos int, parent int, depth int, child_idx int, disc string, data string, n_children int, path_key long"
IGNORE = "fingerprint string, reason string, members array<string>"
MEMBER_FIELDS = ("unit_id", "name", "kind", "file", "line_start", "line_end", "parent_name")

# Kinds of units, as reports show them.
KINDS = ("function", "method", "closure", "class", "impl block", "trait impl block", "if branch", "match arm", "loop body", "block")


def names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]
