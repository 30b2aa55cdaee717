"""Trees, keys and similarity: worked vectors, and the identity of tree walk and key sets on random trees."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.frontend.tree import PLACEHOLDERS, Node, Numbering, canonical, count, fingerprint, leaf, name_leaf, node, none, renumbered, rows, sub_units

INT, V0, V1 = leaf("Literal", "Int"), leaf("Placeholder", "Variable#0"), leaf("Placeholder", "Variable#1")


def keys(x):
    return {r["path_key"] for r in rows(x) if r["disc"] != "None"}


def dice(a, b):
    total = count(a) + count(b)
    return 2 * len(keys(a) & keys(b)) / total if total else 1.0


def walk(a, b):
    """Nodes matched by a parallel walk, written independently of keys."""
    if a.disc == "None" or b.disc == "None":
        return 0
    same_way = a.disc == b.disc and (a.disc != "MacroCall" or a.data == b.data)
    here = int(a.disc == b.disc and a.data == b.data)
    return here + (sum(walk(x, y) for x, y in zip(a.kids, b.kids, strict=False)) if same_way else 0)


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [
        (INT, INT, 1.0),
        (INT, leaf("PatWild"), 0.0),
        (none(), none(), 1.0),
        (none(), INT, 0.0),
        (node("Block", INT, INT, INT), node("Block", INT, INT, INT, V0, V1), 0.8),
        (node("If", V0, node("Block", INT), node("Block", INT)), node("If", V0, node("Block", INT), none()), 0.8),
        (node("Return", INT), node("Return"), 2 / 3),
        (node("BinaryOp", V0, INT, data="Add"), node("BinaryOp", V0, INT, data="Sub"), 2 / 3),
        (node("MacroCall", INT, data="println"), node("MacroCall", INT, data="eprintln"), 0.0),
        (node("MacroCall", INT, data="println"), node("MacroCall", INT, V0, data="println"), 0.8),
    ],
)
def test_dice_vectors(a, b, score):
    assert dice(a, b) == pytest.approx(score)
    assert dice(b, a) == pytest.approx(score)


TREES = st.recursive(
    st.sampled_from([("Literal", "Int"), ("Placeholder", "Variable#0"), ("None", ""), ("Opaque", "")]).map(lambda x: leaf(*x)),
    lambda kids: st.tuples(st.sampled_from([("Block", ""), ("BinaryOp", "Add"), ("BinaryOp", "Sub"), ("MacroCall", "a"), ("MacroCall", "b"), ("If", "")]), st.lists(kids, max_size=4)).map(lambda x: Node(x[0][0], x[0][1], x[1])),
    max_leaves=12,
)


@settings(max_examples=300, deadline=None)
@given(TREES, TREES)
def test_walk_equals_key_intersection(a, b):
    assert walk(a, b) == len(keys(a) & keys(b))
    assert count(a) == len(keys(a))


def test_absent_children_are_hashed_but_not_counted():
    a, b = node("Return", none()), node("Return")
    assert count(a) == count(b) == 1
    assert fingerprint(a) != fingerprint(b)


def test_signature_and_body_have_a_boundary():
    assert fingerprint(INT, V0) != fingerprint(node("Block", INT, V0))
    assert len(fingerprint(INT)) == 16


def test_numbering_counts_each_kind_by_itself():
    t = Numbering().resolve(node("Block", name_leaf("Variable", "x"), name_leaf("Type", "X"), name_leaf("Variable", "y"), name_leaf("Variable", "x")))
    assert [k.data for k in t.kids] == ["Variable#0", "Type#0", "Variable#1", "Variable#0"]


def test_numbering_follows_visit_order():
    t = Numbering().resolve(node("FieldAccess", name_leaf("Variable", "base"), name_leaf("Variable", "field"), order=(1, 0)))
    assert [k.data for k in t.kids] == ["Variable#1", "Variable#0"]


def test_renumbering_joins_the_three_placeholder_discs():
    t = renumbered(node("Block", leaf("PatPlaceholder", "Variable#4"), leaf("Placeholder", "Variable#4"), leaf("Placeholder", "Variable#2")))
    assert [k.data for k in t.kids] == ["Variable#0", "Variable#0", "Variable#1"]
    assert {k.disc for k in t.kids} <= PLACEHOLDERS


def test_sub_units_of_each_kind():
    body = node("Block", INT, INT)
    t = node("Block", node("If", V0, body, body), node("Match", V0, node("MatchArm", V0, none(), body)), node("Loop", body), node("While", V0, body), node("ForLoop", V0, V1, body), node("Closure", body))
    found = [(k, d) for k, d, _ in sub_units(t, 1)]
    assert found == [("if branch", "if-then branch"), ("if branch", "if-else branch"), ("match arm", "match arm 1"), ("loop body", "loop body"), ("loop body", "while body"), ("loop body", "for body"), ("block", "closure body")]
    assert sub_units(t, 4) == []


def test_else_if_is_a_branch_and_is_searched():
    inner = node("If", V0, node("Block", INT), none())
    assert [d for _, d, _ in sub_units(node("If", V0, node("Block", INT), inner), 1)] == ["if-then branch", "if-else branch", "if-then branch"]


def test_canonical_form():
    assert canonical(node("Return", INT)) == "Return::1|Literal:Int:0"
