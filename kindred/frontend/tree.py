"""Normalized trees inside a front-end, before they become rows.

A node has a discriminant, data that is part of its identity (operator, literal kind, placeholder) and children.
Identifiers are first kept by name and numbered afterwards in visit order, which ``order`` may set apart from the order
of the children.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

PLACEHOLDERS = frozenset({"Placeholder", "PatPlaceholder", "TypePlaceholder"})


@dataclass(slots=True)
class Node:
    disc: str
    data: str = ""
    kids: list[Node] = field(default_factory=list)
    ident: tuple[str, str] | None = None  # (placeholder kind, name) until numbered
    order: tuple[int, ...] | None = None


def leaf(disc: str, data: str = "") -> Node:
    return Node(disc, data)


def node(disc: str, *kids: Node, data: str = "", order: tuple[int, ...] | None = None) -> Node:
    return Node(disc, data, list(kids), None, order)


def none() -> Node:
    return Node("None")


def opt(x: Node | None) -> Node:
    return none() if x is None else x


def name_leaf(kind: str, name: str, disc: str = "Placeholder") -> Node:
    return Node(disc, "", [], (kind, name))


def preorder(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(reversed(x.kids))


class Numbering:
    """Index of each (kind, name): first use first, each kind counted by itself."""

    def __init__(self):
        self.index: dict[tuple[str, str], int] = {}
        self.count: dict[str, int] = {}

    def of(self, kind: str, name: str) -> str:
        key = (kind, name)
        if key not in self.index:
            self.index[key] = self.count.get(kind, 0)
            self.count[kind] = self.index[key] + 1
        return f"{kind}#{self.index[key]}"

    def resolve(self, root: Node) -> Node:
        stack = [root]
        while stack:
            x = stack.pop()
            if x.ident:
                x.data = self.of(*x.ident)
            kids = x.kids if x.order is None else [x.kids[i] for i in x.order if i < len(x.kids)] + x.kids[len(x.order) :]
            stack.extend(reversed(kids))
        return root


def renumbered(root: Node) -> Node:
    """A copy whose placeholders count from 0 again, by first occurrence in preorder."""
    numbers = Numbering()
    out: list[Node] = []
    stack: list[tuple[Node, Node | None]] = [(root, None)]
    while stack:
        x, parent = stack.pop()
        data = x.data
        if x.disc in PLACEHOLDERS:
            data = numbers.of(x.data.partition("#")[0], x.data)
        copy = Node(x.disc, data)
        out.append(copy)
        if parent is not None:
            parent.kids.append(copy)
        stack.extend((k, copy) for k in reversed(x.kids))
    return out[0]


def count(root: Node) -> int:
    return sum(x.disc != "None" for x in preorder(root))


def canonical(root: Node) -> str:
    """Preorder tokens; absent children are part of it."""
    return "|".join(f"{x.disc}:{x.data}:{len(x.kids)}" for x in preorder(root))


def fingerprint(*trees: Node) -> str:
    return hashlib.md5("#".join(map(canonical, trees)).encode()).hexdigest()[:16]


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=8).digest(), "little", signed=True)


def rows(root: Node) -> list[dict]:
    """Preorder rows; ``path_key`` hashes the way down to a node (what must agree for both trees to get there) and it."""
    out: list[dict] = []
    stack: list[tuple[Node, int, int, int, int]] = [(root, -1, 0, 0, 0)]
    while stack:
        x, parent, depth, nth, chain = stack.pop()
        pos = len(out)
        here = _hash(chain, nth, x.disc, x.data if x.disc == "MacroCall" else "")
        out.append({"pos": pos, "parent": parent, "depth": depth, "child_idx": nth, "disc": x.disc, "data": x.data, "n_children": len(x.kids), "path_key": _hash(chain, nth, x.disc, x.data)})
        stack.extend((k, pos, depth + 1, i, here) for i, k in reversed(list(enumerate(x.kids))))
    return out


def sub_units(root: Node, min_nodes: int) -> list[tuple[str, str, Node]]:
    """(kind, description, renumbered tree) of branches, arms and bodies, outer ones before inner ones."""
    found: list[tuple[str, str, Node]] = []
    bodies = {("Loop", 0): "loop body", ("While", 1): "while body", ("ForLoop", 2): "for body"}
    for x in preorder(root):
        picked: list[tuple[str, str, Node]] = []
        if x.disc == "If":
            picked = [("if branch", name, x.kids[i]) for i, name in ((1, "if-then branch"), (2, "if-else branch")) if i < len(x.kids)]
        elif x.disc == "Match":
            picked = [("match arm", f"match arm {i}", arm.kids[2]) for i, arm in enumerate(x.kids[1:], 1) if len(arm.kids) > 2]
        elif x.disc == "Closure" and x.kids:
            picked = [("block", "closure body", x.kids[0])]
        else:
            picked = [("loop body", name, x.kids[i]) for (disc, i), name in bodies.items() if disc == x.disc and i < len(x.kids)]
        for kind, description, tree in picked:
            if tree.disc != "None" and count(tree) >= min_nodes:
                found.append((kind, description, renumbered(tree)))
    return found


@dataclass(slots=True)
class Unit:
    kind: str
    name: str
    line_start: int
    line_end: int
    signature: Node
    body: Node
    is_test: bool = False
    body_only: bool = False  # closures: fingerprint and size come from the body alone

    @property
    def node_count(self) -> int:
        return count(self.body) + (0 if self.body_only else count(self.signature))

    def fingerprint(self) -> str:
        return fingerprint(self.body) if self.body_only else fingerprint(self.signature, self.body)

    def admitted(self, min_nodes: int, min_lines: int) -> bool:
        lines = max(self.line_end - self.line_start, 0) + 1
        return self.node_count >= min_nodes and (min_lines <= 0 or lines >= min_lines)


def admitted(units: Sequence[Unit], min_nodes: int, min_lines: int) -> list[Unit]:
    return [u for u in units if u.admitted(min_nodes, min_lines)]
