"""Front-end for concrete syntax trees: a grammar is one table from node kinds to rules.

A rule turns a concrete node into a normalized one, and may declare that nodes of its kind are units.  Rules name the
parts of a node by short paths:

    "left"          the node in a field, or an absent child
    "arguments/*"   all members of the node in a field
    "*"             all members: named children that the table does not drop
    "*case"         the members of one kind

Kinds without a rule are transparent: one member stands for its parent, several form a block, none is opaque.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from .captures import Query, matches
from .registry import Analyzer
from .tree import Node, Numbering, Unit, leaf, name_leaf, node, none


@dataclass
class Cst:
    kind: str
    text: str = ""
    children: Sequence[Cst] = ()
    fields: Mapping[str, Cst] = field(default_factory=dict)
    named: bool = True
    line_start: int = 1
    line_end: int = 1


class Rule(Protocol):
    def build(self, x: Cst, grammar: Grammar) -> Node: ...


@dataclass(frozen=True)
class Name:
    """An identifier; ``space`` is the kind of placeholder that it gets."""

    space: str = "Variable"

    def build(self, x: Cst, grammar: Grammar) -> Node:
        return name_leaf(self.space, x.text)


@dataclass(frozen=True)
class Leaf:
    """A node that hides what is below it: a literal of some kind, or something opaque."""

    disc: str = "Opaque"
    data: str = ""

    def build(self, x: Cst, grammar: Grammar) -> Node:
        return leaf(self.disc, self.data)


class Dropped(Leaf):
    """Left out among members, opaque where a field holds it."""


@dataclass(frozen=True)
class Shape:
    """A node with the named parts."""

    disc: str
    parts: tuple[str, ...] = ("*",)

    def build(self, x: Cst, grammar: Grammar) -> Node:
        return node(self.disc, *grammar.parts(x, self.parts))


@dataclass(frozen=True)
class Infix:
    """A binary operation; its operator is the first unnamed child.

    Without both fields its members are the operands: more than two lean to the right, fewer are filled up.
    """

    operators: Mapping[str, str]
    left: str = "left"
    right: str = "right"

    def build(self, x: Cst, grammar: Grammar) -> Node:
        data = grammar.operator(x, self.operators)
        sides = (self.left, self.right) if {self.left, self.right} <= x.fields.keys() else ("*",)
        operands = grammar.parts(x, sides)
        operands += [none()] * (2 - len(operands))
        while len(operands) > 1:
            b, a = operands.pop(), operands.pop()
            operands.append(node("BinaryOp", a, b, data=data))
        return operands[0]


@dataclass(frozen=True)
class Prefix:
    """A unary operation on the first of ``fields`` that is there, or on its first member."""

    operators: Mapping[str, str]
    fields: tuple[str, ...] = ("argument", "operand")

    def build(self, x: Cst, grammar: Grammar) -> Node:
        held = [f for f in self.fields if f in x.fields]
        operands = grammar.parts(x, (held[0],) if held else ("*",))
        return node("UnaryOp", *(operands or [none()])[:1], data=grammar.operator(x, self.operators))


@dataclass(frozen=True)
class Defines:
    """Nodes of this kind are units; where they lie inside another one they are shaped by ``within``."""

    unit_kind: str = "function"
    within: Rule = Shape("Block")
    name: str = "name"
    parameters: str = "parameters"
    body: str = "body"

    def build(self, x: Cst, grammar: Grammar) -> Node:
        return self.within.build(x, grammar)


OPAQUE, DROPPED, BLOCK = Leaf(), Dropped(), Shape("Block")
BROKEN = frozenset({"ERROR", "MISSING"})  # kinds that tolerant parsers give to what they could not read


class Grammar:
    """Normalizes trees by its table, which maps a kind, or a tuple of kinds, to a rule."""

    def __init__(self, table: Mapping[str | tuple[str, ...], Rule]):
        self.rules: dict[str, Rule] = {}
        for kinds, rule in table.items():
            self.rules |= dict.fromkeys((kinds,) if isinstance(kinds, str) else kinds, rule)
        self.rules |= dict.fromkeys(BROKEN, OPAQUE)

    def members(self, x: Cst) -> list[Cst]:
        return [c for c in x.children if c.named and not isinstance(self.rules.get(c.kind), Dropped)]

    def parts(self, x: Cst, paths: Sequence[str]) -> list[Node]:
        out: list[Node] = []
        for path in paths:
            name, _, deep = path.partition("/")
            if path.startswith("*"):
                out += [self.normalize(c) for c in self.members(x) if path in ("*", "*" + c.kind)]
            elif name not in x.fields:
                out += [] if deep else [none()]
            else:
                out += self.parts(x.fields[name], (deep,)) if deep else [self.normalize(x.fields[name])]
        return out

    @staticmethod
    def operator(x: Cst, names: Mapping[str, str]) -> str:
        signs = [c.text for c in x.children if not c.named]
        return names.get(signs[0], "Other") if signs else "Other"

    def normalize(self, x: Cst) -> Node:
        if rule := self.rules.get(x.kind):
            return rule.build(x, self)
        below = self.parts(x, ("*",)) if x.named else []
        if len(below) == 1:
            return below[0]
        return node("Block", *below) if below else leaf("Opaque")


def nodes_of(root: Cst) -> Iterator[Cst]:
    """In preorder."""
    stack = [root]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(reversed(x.children))


def _found(root: Cst, grammar: Grammar, queries: Sequence[Query]) -> Iterator[tuple[Cst, str, Mapping[str, Cst]]]:
    """(node, unit kind, parts by name) of declared units, or of what the queries capture where there are any."""
    for x in nodes_of(root):
        if queries:
            for query in queries:
                if captured := matches(query, x):
                    yield x, query.unit_kind, captured
        elif isinstance(rule := grammar.rules.get(x.kind), Defines):
            yield x, rule.unit_kind, {part: x.fields[f] for part, f in (("name", rule.name), ("parameters", rule.parameters), ("body", rule.body)) if f in x.fields}


def cst_units(root: Cst, path: str, grammar: Grammar, queries: Sequence[Query] = (), is_test: Callable[[str, str], bool] = lambda kind, name: False) -> list[Unit]:
    """Units in preorder, those without a body left out.  Each numbers its names anew, parameters before body."""
    out = []
    for x, kind, parts in _found(root, grammar, queries):
        if "body" not in parts:
            continue
        numbers = Numbering()
        signature = numbers.resolve(grammar.normalize(parts["parameters"]) if "parameters" in parts else none())
        body = numbers.resolve(grammar.normalize(parts["body"]))
        name = parts["name"].text if "name" in parts else f"anonymous at {path}:{x.line_start}"
        out.append(Unit(kind, name, x.line_start, x.line_end, signature, body, is_test(kind, name)))
    return out


def mapped_analyzer(name: str, extensions: Sequence[str], parse: Callable[[str], Cst], grammar: Grammar, queries: Sequence[Query] = (), is_test: Callable[[str, str], bool] = lambda kind, name: False) -> Analyzer:
    """An analyzer from a parser of concrete trees, a grammar and, if wanted, queries that capture units."""
    return Analyzer(name, tuple(extensions), lambda path, text: cst_units(parse(text), path, grammar, queries, is_test))
