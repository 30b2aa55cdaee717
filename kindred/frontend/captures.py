"""Queries that capture parts of concrete trees, written as patterns in parentheses.

    (function_definition name: (identifier) @name parameters: (_) @parameters body: (block) @body) @function

A pattern names a node's kind, or ``_`` for any, and patterns of fields or of children in order; ``@label`` after a
pattern captures its node.  A trailing ``?`` makes a field optional.  The label of the outermost pattern is the kind of
unit that a match stands for.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

_COMMENT = re.compile(r";[^\n]*")
_TOKEN = re.compile(r"\s*(?:(?P<punct>[()?])|@(?P<label>[\w.]+)|(?P<field>\w+):|(?P<word>\w+))")


@dataclass(frozen=True)
class Pattern:
    kind: str
    parts: tuple[tuple[str | None, Pattern, bool], ...] = ()  # (field, pattern, optional)
    label: str | None = None


@dataclass(frozen=True)
class Query:
    pattern: Pattern

    @property
    def unit_kind(self) -> str:
        return self.pattern.label or "function"


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = _COMMENT.sub("", text).rstrip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(f"not a query: {text[at : at + 20]!r}")
        out.append((found.lastgroup, found[found.lastgroup]))
        at = found.end()
    return out


def parse_queries(text: str) -> list[Query]:
    """All patterns of a text; a comment runs from ``;`` to the end of its line."""
    tokens, at = _tokens(text), 0

    def take(kind: str, value: str | None = None) -> str | None:
        nonlocal at
        if at < len(tokens) and tokens[at][0] == kind and value in (None, tokens[at][1]):
            at += 1
            return tokens[at - 1][1]
        return None

    def pattern() -> Pattern:
        if not take("punct", "("):
            raise ValueError("a pattern begins with a parenthesis")
        kind, parts = take("word"), []
        if kind is None:
            raise ValueError("a pattern names a kind")
        while not take("punct", ")"):
            name = take("field")
            part = pattern()
            parts.append((name, part, take("punct", "?") is not None))
        return Pattern(kind, tuple(parts), take("label"))

    out = []
    while at < len(tokens):
        out.append(Query(pattern()))
    return out


def _match(p: Pattern, x, found: dict) -> bool:
    if p.kind not in ("_", x.kind):
        return False
    if p.label:
        found[p.label] = x
    rest = iter([c for c in x.children if c.named])
    for name, part, optional in p.parts:
        held = [x.fields[name]] if name in x.fields else []
        fits = any(_match(part, c, found) for c in (held if name else rest))
        if not fits and not optional:
            return False
    return True


def matches(query: Query, x) -> Mapping[str, object] | None:
    """Captured nodes by label, if the pattern fits this node."""
    found: dict = {}
    return found if _match(query.pattern, x, found) else None
