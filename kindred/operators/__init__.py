"""Relational operators over units, groups and the ignore list."""
