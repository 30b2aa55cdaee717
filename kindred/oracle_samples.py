"""Expected units of the sources in ``samples``: what normalization must make of each, written out in full."""

from __future__ import annotations

#: (file, section, kind, name, first line, last line, signature or None where it does not count, body, parent, is test)
PYTHON = [
    ("loops.py", "unit", "function", "total", 1, 6, "Placeholder:Variable#0:0", "Block::3|Assign::2|Placeholder:Variable#1:0|Literal:Int:0|ForLoop::3|Placeholder:Variable#2:0|Placeholder:Variable#0:0|Block::1|If::3|BinaryOp:Gt:2|Placeholder:Variable#2:0|Literal:Int:0|Block::1|BinaryOp:AddAssign:2|Placeholder:Variable#1:0|Placeholder:Variable#2:0|None::0|Return::1|Placeholder:Variable#1:0", None, False),
    ("loops.py", "sub", "loop body", "for body", 1, 6, None, "Block::1|If::3|BinaryOp:Gt:2|Placeholder:Variable#0:0|Literal:Int:0|Block::1|BinaryOp:AddAssign:2|Placeholder:Variable#1:0|Placeholder:Variable#0:0|None::0", "total", False),
    ("loops.py", "sub", "if branch", "if-then branch", 1, 6, None, "Block::1|BinaryOp:AddAssign:2|Placeholder:Variable#0:0|Placeholder:Variable#1:0", "total", False),
    ("loops.py", "unit", "function", "amount", 9, 14, "Placeholder:Variable#0:0", "Block::3|Assign::2|Placeholder:Variable#1:0|Literal:Int:0|ForLoop::3|Placeholder:Variable#2:0|Placeholder:Variable#0:0|Block::1|If::3|BinaryOp:Gt:2|Placeholder:Variable#2:0|Literal:Int:0|Block::1|BinaryOp:AddAssign:2|Placeholder:Variable#1:0|Placeholder:Variable#2:0|None::0|Return::1|Placeholder:Variable#1:0", None, False),
    ("loops.py", "sub", "loop body", "for body", 9, 14, None, "Block::1|If::3|BinaryOp:Gt:2|Placeholder:Variable#0:0|Literal:Int:0|Block::1|BinaryOp:AddAssign:2|Placeholder:Variable#1:0|Placeholder:Variable#0:0|None::0", "amount", False),
    ("loops.py", "sub", "if branch", "if-then branch", 9, 14, None, "Block::1|BinaryOp:AddAssign:2|Placeholder:Variable#0:0|Placeholder:Variable#1:0", "amount", False),
    ("shapes.py", "unit", "class", "Box", 1, 21, "None::0", "Block::3|Literal:Str:0|Block::3|Placeholder:Variable#0:0|Block::4|Placeholder:Variable#1:0|Placeholder:Variable#2:0|Block::2|Placeholder:Variable#3:0|Literal:Float:0|Placeholder:Variable#4:0|Block::2|While::2|BinaryOp:And:2|UnaryOp:Not:1|FieldAccess::2|Placeholder:Variable#1:0|Placeholder:Variable#5:0|BinaryOp:Lt:2|Placeholder:Variable#3:0|BinaryOp:Lt:2|Literal:Int:0|Literal:Int:0|Block::2|Index::2|FieldAccess::2|Placeholder:Variable#1:0|Placeholder:Variable#6:0|Literal:Int:0|Break::0|Return::1|Tuple::5|FieldAccess::2|Placeholder:Variable#1:0|Placeholder:Variable#7:0|Literal:Str:0|Literal:Str:0|Literal:Null:0|Literal:Bool:0|Block::3|Placeholder:Variable#8:0|Placeholder:Variable#1:0|Block::2|Block::2|Block::2|Block::2|Call::2|Placeholder:Variable#9:0|FieldAccess::2|Placeholder:Variable#1:0|Placeholder:Variable#10:0|Placeholder:Variable#11:0|Placeholder:Variable#12:0|Block::1|Yield::1|Block::3|Call::1|FieldAccess::2|Placeholder:Variable#13:0|Placeholder:Variable#14:0|Block::2|Placeholder:Variable#13:0|Placeholder:Variable#11:0|Placeholder:Variable#13:0|Block::3|Block::1|Block::2|Block::2|Placeholder:Variable#15:0|Placeholder:Variable#10:0|Placeholder:Variable#16:0|Block::2|Block::2|Tuple::2|Placeholder:Variable#17:0|Placeholder:Variable#18:0|Placeholder:Variable#19:0|Block::1|Block::2|Call::2|Placeholder:Variable#20:0|Literal:Str:0|Placeholder:Variable#19:0|Block::1|Block::2|FieldAccess::2|Placeholder:Variable#1:0|Placeholder:Variable#21:0|Literal:Str:0", None, False),
    ("shapes.py", "sub", "loop body", "while body", 1, 21, None, "Block::2|Index::2|FieldAccess::2|Placeholder:Variable#0:0|Placeholder:Variable#1:0|Literal:Int:0|Break::0", "Box", False),
    ("shapes.py", "unit", "function", "size", 5, 11, "Block::4|Placeholder:Variable#0:0|Placeholder:Variable#1:0|Block::2|Placeholder:Variable#2:0|Literal:Float:0|Placeholder:Variable#3:0", "Block::2|While::2|BinaryOp:And:2|UnaryOp:Not:1|FieldAccess::2|Placeholder:Variable#0:0|Placeholder:Variable#4:0|BinaryOp:Lt:2|Placeholder:Variable#2:0|BinaryOp:Lt:2|Literal:Int:0|Literal:Int:0|Block::2|Index::2|FieldAccess::2|Placeholder:Variable#0:0|Placeholder:Variable#5:0|Literal:Int:0|Break::0|Return::1|Tuple::5|FieldAccess::2|Placeholder:Variable#0:0|Placeholder:Variable#6:0|Literal:Str:0|Literal:Str:0|Literal:Null:0|Literal:Bool:0", None, False),
    ("shapes.py", "sub", "loop body", "while body", 5, 11, None, "Block::2|Index::2|FieldAccess::2|Placeholder:Variable#0:0|Placeholder:Variable#1:0|Literal:Int:0|Break::0", "size", False),
    ("shapes.py", "unit", "function", "walk", 13, 21, "Placeholder:Variable#0:0", "Block::2|Block::2|Block::2|Block::2|Call::2|Placeholder:Variable#1:0|FieldAccess::2|Placeholder:Variable#0:0|Placeholder:Variable#2:0|Placeholder:Variable#3:0|Placeholder:Variable#4:0|Block::1|Yield::1|Block::3|Call::1|FieldAccess::2|Placeholder:Variable#5:0|Placeholder:Variable#6:0|Block::2|Placeholder:Variable#5:0|Placeholder:Variable#3:0|Placeholder:Variable#5:0|Block::3|Block::1|Block::2|Block::2|Placeholder:Variable#7:0|Placeholder:Variable#2:0|Placeholder:Variable#8:0|Block::2|Block::2|Tuple::2|Placeholder:Variable#9:0|Placeholder:Variable#10:0|Placeholder:Variable#11:0|Block::1|Block::2|Call::2|Placeholder:Variable#12:0|Literal:Str:0|Placeholder:Variable#11:0|Block::1|Block::2|FieldAccess::2|Placeholder:Variable#0:0|Placeholder:Variable#13:0|Literal:Str:0", None, False),
    ("choices.py", "unit", "function", "pick", 1, 8, "Placeholder:Variable#0:0", "Block::1|Match::4|Placeholder:Variable#0:0|MatchArm::3|Block::2|Placeholder:Variable#1:0|Placeholder:Variable#2:0|Placeholder:Variable#1:0|Block::1|Return::1|StructInit::1|Block::2|Placeholder:Variable#1:0|Placeholder:Variable#2:0|MatchArm::3|Block::2|Literal:Str:0|Literal:Int:0|None::0|Block::1|Return::1|Set::2|Placeholder:Variable#0:0|UnaryOp:Neg:1|Placeholder:Variable#0:0|MatchArm::3|Opaque::0|None::0|Block::1|Return::1|Index::2|Block::3|Placeholder:Variable#3:0|Block::2|Placeholder:Variable#3:0|Placeholder:Variable#0:0|Placeholder:Variable#3:0|Block::2|Literal:Int:0|Literal:Int:0", None, False),
    ("choices.py", "sub", "match arm", "match arm 1", 1, 8, None, "Block::1|Return::1|StructInit::1|Block::2|Placeholder:Variable#0:0|Placeholder:Variable#1:0", "pick", False),
    ("choices.py", "sub", "match arm", "match arm 2", 1, 8, None, "Block::1|Return::1|Set::2|Placeholder:Variable#0:0|UnaryOp:Neg:1|Placeholder:Variable#0:0", "pick", False),
    ("choices.py", "sub", "match arm", "match arm 3", 1, 8, None, "Block::1|Return::1|Index::2|Block::3|Placeholder:Variable#0:0|Block::2|Placeholder:Variable#0:0|Placeholder:Variable#1:0|Placeholder:Variable#0:0|Block::2|Literal:Int:0|Literal:Int:0", "pick", False),
    ("choices.py", "unit", "closure", "anonymous at choices.py:11", 11, 11, "Block::2|Placeholder:Variable#0:0|Block::2|Placeholder:Variable#1:0|Literal:Int:0", "Block::3|FieldAccess::2|Placeholder:Variable#0:0|Placeholder:Variable#2:0|Placeholder:Variable#0:0|BinaryOp:Pow:2|Placeholder:Variable#1:0|Literal:Int:0", None, False),
    ("test_parts.py", "unit", "function", "test_one", 1, 8, "Opaque::0", "Block::4|Assign::2|Placeholder:Variable#0:0|Literal:Int:0|Assign::2|Block::2|Placeholder:Variable#1:0|Placeholder:Variable#2:0|Call::4|Placeholder:Variable#3:0|Literal:Int:0|Block::2|Placeholder:Variable#4:0|Literal:Int:0|Array::1|Literal:Int:0|If::3|BinaryOp:In:2|Block::2|Placeholder:Variable#5:0|Call::2|Placeholder:Variable#6:0|Placeholder:Variable#2:0|Placeholder:Variable#1:0|Block::1|Assign::2|Placeholder:Variable#1:0|BinaryOp:Other:2|Placeholder:Variable#2:0|Placeholder:Variable#5:0|Block::2|BinaryOp:IsNot:2|Placeholder:Variable#1:0|Placeholder:Variable#2:0|Block::1|Placeholder:Variable#7:0|Placeholder:Variable#1:0", None, True),
    ("test_parts.py", "sub", "if branch", "if-then branch", 1, 8, None, "Block::1|Assign::2|Placeholder:Variable#0:0|BinaryOp:Other:2|Placeholder:Variable#1:0|Placeholder:Variable#2:0", "test_one", True),
    ("test_parts.py", "sub", "if branch", "if-else branch", 1, 8, None, "Block::2|BinaryOp:IsNot:2|Placeholder:Variable#0:0|Placeholder:Variable#1:0|Block::1|Placeholder:Variable#2:0", "test_one", True),
    ("test_parts.py", "unit", "closure", "anonymous at test_parts.py:2", 2, 2, "None::0", "Literal:Int:0", None, False),
]
RUST = [
    ("loops.rs", "unit", "function", "total", 1, 5, "FnSignature::2|TypePlaceholder:Type#0:0|FieldValue::2|PatPlaceholder:Variable#0:0|TypeReference::1|TypeSlice::1|TypePlaceholder:Type#0:0", "Block::3|LetBinding::4|PatPlaceholder:Variable#1:0|None::0|Literal:Int:0|None::0|ForLoop::3|PatPlaceholder:Variable#2:0|Placeholder:Variable#0:0|Block::1|If::3|BinaryOp:Gt:2|UnaryOp:Deref:1|Placeholder:Variable#2:0|Literal:Int:0|Block::1|Semi::1|BinaryOp:AddAssign:2|Placeholder:Variable#1:0|UnaryOp:Deref:1|Placeholder:Variable#2:0|None::0|Placeholder:Variable#1:0", None, False),
    ("loops.rs", "sub", "loop body", "for body", 1, 5, None, "Block::1|If::3|BinaryOp:Gt:2|UnaryOp:Deref:1|Placeholder:Variable#0:0|Literal:Int:0|Block::1|Semi::1|BinaryOp:AddAssign:2|Placeholder:Variable#1:0|UnaryOp:Deref:1|Placeholder:Variable#0:0|None::0", "total", False),
    ("loops.rs", "sub", "if branch", "if-then branch", 1, 5, None, "Block::1|Semi::1|BinaryOp:AddAssign:2|Placeholder:Variable#0:0|UnaryOp:Deref:1|Placeholder:Variable#1:0", "total", False),
    ("loops.rs", "unit", "function", "amount", 7, 11, "FnSignature::2|TypePlaceholder:Type#0:0|FieldValue::2|PatPlaceholder:Variable#0:0|TypeReference::1|TypeSlice::1|TypePlaceholder:Type#0:0", "Block::3|LetBinding::4|PatPlaceholder:Variable#1:0|None::0|Literal:Int:0|None::0|ForLoop::3|PatPlaceholder:Variable#2:0|Placeholder:Variable#0:0|Block::1|If::3|BinaryOp:Gt:2|UnaryOp:Deref:1|Placeholder:Variable#2:0|Literal:Int:0|Block::1|Semi::1|BinaryOp:AddAssign:2|Placeholder:Variable#1:0|UnaryOp:Deref:1|Placeholder:Variable#2:0|None::0|Placeholder:Variable#1:0", None, False),
    ("loops.rs", "sub", "loop body", "for body", 7, 11, None, "Block::1|If::3|BinaryOp:Gt:2|UnaryOp:Deref:1|Placeholder:Variable#0:0|Literal:Int:0|Block::1|Semi::1|BinaryOp:AddAssign:2|Placeholder:Variable#1:0|UnaryOp:Deref:1|Placeholder:Variable#0:0|None::0", "amount", False),
    ("loops.rs", "sub", "if branch", "if-then branch", 7, 11, None, "Block::1|Semi::1|BinaryOp:AddAssign:2|Placeholder:Variable#0:0|UnaryOp:Deref:1|Placeholder:Variable#1:0", "amount", False),
    ("items.rs", "unit", "method", "Shape::area", 2, 2, "FnSignature::3|TypePlaceholder:Type#0:0|Reference::1|Placeholder:Variable#0:0|FieldValue::2|PatPlaceholder:Variable#1:0|TypePlaceholder:Type#1:0", "Block::1|MethodCall::2|MethodCall::3|MethodCall::2|FieldAccess::2|Placeholder:Variable#0:0|Placeholder:Variable#2:0|Placeholder:Function#2:0|Placeholder:Function#1:0|Closure::2|BinaryOp:Mul:2|FieldAccess::2|Placeholder:Variable#4:0|Placeholder:Variable#3:0|FieldAccess::2|Placeholder:Variable#4:0|Placeholder:Variable#5:0|PatPlaceholder:Variable#4:0|Placeholder:Function#0:0", None, False),
    ("items.rs", "sub", "block", "closure body", 2, 2, None, "BinaryOp:Mul:2|FieldAccess::2|Placeholder:Variable#0:0|Placeholder:Variable#1:0|FieldAccess::2|Placeholder:Variable#0:0|Placeholder:Variable#2:0", "Shape::area", False),
    ("items.rs", "unit", "method", "Shape::tuple", 3, 3, "FnSignature::2|TypeTuple::2|TypePlaceholder:Type#0:0|TypePlaceholder:Type#1:0|Placeholder:Variable#0:0", "Block::1|Tuple::2|FieldAccess::2|Placeholder:Variable#0:0|Placeholder:Variable#1:0|Repeat::2|Literal:Int:0|Literal:Int:0", None, False),
    ("items.rs", "unit", "trait impl block", "<Shape as Draw>::draw", 5, 5, "FnSignature::2|None::0|Reference:mut:1|Placeholder:Variable#0:0", "Block::1|Semi::1|MacroCall:println:2|Literal:Str:0|Placeholder:Variable#0:0", None, False),
    ("items.rs", "unit", "closure", "closure at items.rs:6", 6, 6, None, "Closure::1|MethodCall::2|Placeholder:Variable#0:0|Placeholder:Function#0:0", None, False),
    ("items.rs", "sub", "block", "closure body", 6, 6, None, "MethodCall::2|Placeholder:Variable#0:0|Placeholder:Function#0:0", "closure at items.rs:6", False),
    ("choices.rs", "unit", "function", "pick", 1, 12, "FnSignature::3|TypePlaceholder:Type#0:0|FieldValue::2|PatPlaceholder:Variable#0:0|TypePlaceholder:Type#1:0|FieldValue::2|PatPlaceholder:Variable#1:0|TypeReference:mut:1|TypePlaceholder:Type#2:0", "Block::5|LetBinding::4|PatStruct::1|PatPlaceholder:Variable#2:0|None::0|Placeholder:Variable#0:0|Block::1|Return::1|Call::2|Placeholder:Type#3:0|Path::2|Placeholder:Type#4:0|Placeholder:Type#5:0|LetBinding::4|PatPlaceholder:Variable#3:0|None::0|Match::5|Placeholder:Variable#2:0|MatchArm::3|PatLiteral::1|Literal:Int:0|None::0|Literal:Str:0|MatchArm::3|PatOr::2|PatLiteral::1|Literal:Int:0|PatLiteral::1|Literal:Int:0|BinaryOp:Gt:2|Placeholder:Variable#2:0|Literal:Int:0|Literal:Str:0|MatchArm::3|PatRange::2|Literal:Int:0|Literal:Int:0|None::0|Block::2|Semi::1|MethodCall::3|Placeholder:Variable#1:0|Placeholder:Function#0:0|Literal:Byte:0|Literal:Str:0|MatchArm::3|PatWild::0|None::0|MacroCall:unreachable:0|None::0|While::2|LetExpr::2|PatStruct::1|PatPlaceholder:Variable#4:0|MethodCall::2|Placeholder:Variable#1:0|Placeholder:Function#1:0|Block::1|If::3|BinaryOp:Eq:2|Placeholder:Variable#4:0|Literal:Int:0|Block::1|Semi::1|Continue::0|None::0|LetBinding::4|PatPlaceholder:Variable#5:0|None::0|Loop::1|Block::1|Break::1|UnaryOp:Neg:1|Placeholder:Variable#2:0|None::0|Call::2|Placeholder:Type#6:0|BinaryOp:Add:2|Cast::2|Placeholder:Variable#5:0|TypePlaceholder:Type#7:0|Try::1|Call::3|Placeholder:Variable#6:0|Reference::1|Placeholder:Variable#3:0|StructInit::2|Placeholder:Variable#7:0|FieldValue::2|Placeholder:Variable#8:0|Literal:Float:0", None, False),
    ("choices.rs", "sub", "match arm", "match arm 3", 1, 12, None, "Block::2|Semi::1|MethodCall::3|Placeholder:Variable#0:0|Placeholder:Function#0:0|Literal:Byte:0|Literal:Str:0", "pick", False),
    ("choices.rs", "sub", "loop body", "while body", 1, 12, None, "Block::1|If::3|BinaryOp:Eq:2|Placeholder:Variable#0:0|Literal:Int:0|Block::1|Semi::1|Continue::0|None::0", "pick", False),
    ("choices.rs", "sub", "if branch", "if-then branch", 1, 12, None, "Block::1|Semi::1|Continue::0", "pick", False),
    ("choices.rs", "sub", "loop body", "loop body", 1, 12, None, "Block::1|Break::1|UnaryOp:Neg:1|Placeholder:Variable#0:0", "pick", False),
    ("tests.rs", "unit", "function", "one", 4, 4, "FnSignature::1|None::0", "Block::1|Semi::1|MacroCall:assert:1|BinaryOp:Eq:2|Literal:Int:0|Literal:Int:0", None, True),
    ("tests.rs", "unit", "function", "two", 5, 5, "FnSignature::1|None::0", "Block::1|If::3|Literal:Bool:0|Block::2|Semi::1|Call::1|Placeholder:Variable#0:0|Semi::1|Call::1|Placeholder:Variable#1:0|Block::2|Semi::1|Call::1|Placeholder:Variable#2:0|Semi::1|Call::1|Placeholder:Variable#3:0", None, True),
    ("tests.rs", "sub", "if branch", "if-then branch", 5, 5, None, "Block::2|Semi::1|Call::1|Placeholder:Variable#0:0|Semi::1|Call::1|Placeholder:Variable#1:0", "two", True),
    ("tests.rs", "sub", "if branch", "if-else branch", 5, 5, None, "Block::2|Semi::1|Call::1|Placeholder:Variable#0:0|Semi::1|Call::1|Placeholder:Variable#1:0", "two", True),
]
BRACES = [
    ("script.bs", "unit", "function", "total", 1, 6, "Block::2|Placeholder:Variable#0:0|Placeholder:Variable#1:0", "Block::4|Assign::2|Placeholder:Variable#2:0|Literal:Int:0|ForLoop::3|Placeholder:Variable#3:0|Placeholder:Variable#0:0|Block::1|If::3|BinaryOp:Gt:2|Placeholder:Variable#3:0|Placeholder:Variable#1:0|Block::1|BinaryOp:AddAssign:2|Placeholder:Variable#2:0|Placeholder:Variable#3:0|Assign::2|Placeholder:Variable#2:0|UnaryOp:Neg:1|Placeholder:Variable#3:0|While::2|BinaryOp:And:2|BinaryOp:Gt:2|Placeholder:Variable#2:0|Literal:Int:0|UnaryOp:Not:1|Placeholder:Variable#4:0|Block::2|Assign::2|Placeholder:Variable#2:0|BinaryOp:Div:2|Placeholder:Variable#2:0|Literal:Int:0|Break::0|Return::1|Placeholder:Variable#2:0", None, False),
    ("script.bs", "sub", "loop body", "for body", 1, 6, None, "Block::1|If::3|BinaryOp:Gt:2|Placeholder:Variable#0:0|Placeholder:Variable#1:0|Block::1|BinaryOp:AddAssign:2|Placeholder:Variable#2:0|Placeholder:Variable#0:0|Assign::2|Placeholder:Variable#2:0|UnaryOp:Neg:1|Placeholder:Variable#0:0", "total", False),
    ("script.bs", "sub", "if branch", "if-then branch", 1, 6, None, "Block::1|BinaryOp:AddAssign:2|Placeholder:Variable#0:0|Placeholder:Variable#1:0", "total", False),
    ("script.bs", "sub", "if branch", "if-else branch", 1, 6, None, "Assign::2|Placeholder:Variable#0:0|UnaryOp:Neg:1|Placeholder:Variable#1:0", "total", False),
    ("script.bs", "sub", "loop body", "while body", 1, 6, None, "Block::2|Assign::2|Placeholder:Variable#0:0|BinaryOp:Div:2|Placeholder:Variable#0:0|Literal:Int:0|Break::0", "total", False),
    ("script.bs", "unit", "function", "testAfter", 8, 8, "Block::1|Placeholder:Variable#0:0", "Block::2|Opaque::0|Return::1|Array::5|Literal:Int:0|Literal:Str:0|Index::2|FieldAccess::2|Placeholder:Variable#0:0|Placeholder:Variable#1:0|Literal:Int:0|Closure::3|BinaryOp:Add:2|Placeholder:Variable#2:0|BinaryOp:Mul:2|Placeholder:Variable#3:0|Literal:Int:0|Placeholder:Variable#2:0|Placeholder:Variable#3:0|Literal:Null:0", None, True),
    ("script.bs", "sub", "block", "closure body", 8, 8, None, "BinaryOp:Add:2|Placeholder:Variable#0:0|BinaryOp:Mul:2|Placeholder:Variable#1:0|Literal:Int:0", "testAfter", True),
    ("script.bs", "unit", "closure", "anonymous at script.bs:8", 8, 8, "Block::2|Placeholder:Variable#0:0|Placeholder:Variable#1:0", "BinaryOp:Add:2|Placeholder:Variable#0:0|BinaryOp:Mul:2|Placeholder:Variable#1:0|Literal:Int:0", None, False),
]

#: Files that do not parse, and why.
WARNINGS = {"RUST": ["Failed to parse broken.rs: line 1: expected a pattern, found '{'"]}


def units_sql(language: str, rows: list[tuple]) -> str:
    """The rows as SQL; fingerprints and sizes follow from the trees."""
    text = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    nodes = lambda c: f"len(list_filter(string_split({c}, '|'), lambda x: NOT starts_with(x, 'None:')))"
    warned = "".join(f" UNION ALL SELECT 'warning', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {text(w)}" for w in WARNINGS.get(language, ()))
    return (
        f"SELECT section, file, kind, name, line_start, line_end, {nodes('body')} + coalesce({nodes('signature')}, 0) AS node_count, substr(md5(coalesce(signature || '#', '') || body), 1, 16) AS fingerprint, parent_name, is_test, NULL AS warning"
        f" FROM (VALUES {values}) AS t(file, section, kind, name, line_start, line_end, signature, body, parent_name, is_test)" + warned
    )

#: What commands print about samples.SIMILAR.
PRINTED = {
    "sample_report_text": """Duplication Statistics
=====================
Total code units analyzed: 7

Exact duplicates: 1 groups (3 code units)
Near duplicates:  1 groups (2 code units)

Duplicated lines (exact): 15
Duplicated lines (near):  10
Duplication: 45.5% exact, 30.3% near (of 33 total lines)

Sub-function exact: 2 groups (5 units)
Sub-function near:  1 groups (2 units)

Exact Duplicates
================

Group 1 (fingerprint: 5acfdad846eead47, 3 members):
  - total (function) at src/loops.rs:1-5
  - amount (function) at src/loops.rs:7-11
  - total (function) at src/branches.rs:15-19

Near Duplicates
===============

Group 1 (fingerprint: a00c8803469ae2e9, similarity: 95%, 2 members):
  - least (function) at src/less.rs:1-5
  - count (function) at src/less.rs:7-11

Sub-function Exact Duplicates
=============================

Group 1 (fingerprint: 2ceb754ec6023cd7, 3 members):
  - for body (loop body) in total at src/loops.rs:1-5
  - for body (loop body) in amount at src/loops.rs:7-11
  - for body (loop body) in total at src/branches.rs:15-19

Group 2 (fingerprint: 30b6815e8b56b97c, 2 members):
  - if-then branch (if branch) in Gate::open at src/branches.rs:2-4
  - if-then branch (if branch) in close at src/branches.rs:7-11

Sub-function Near Duplicates
============================

Group 1 (fingerprint: 766603a6445b0b20, similarity: 92%, 2 members):
  - for body (loop body) in least at src/less.rs:1-5
  - for body (loop body) in count at src/less.rs:7-11

""",
    "sample_report_json": """{
  "total_code_units": 6,
  "total_lines": 28,
  "exact_duplicate_groups": 1,
  "exact_duplicate_units": 2,
  "near_duplicate_groups": 1,
  "near_duplicate_units": 2,
  "exact_duplicate_lines": 10,
  "near_duplicate_lines": 10,
  "exact_duplicate_percent": 35.714285714285715,
  "near_duplicate_percent": 35.714285714285715,
  "sub_exact_groups": 2,
  "sub_exact_units": 4,
  "sub_near_groups": 1,
  "sub_near_units": 2
}

[
  {
    "fingerprint": "5acfdad846eead47",
    "similarity": 1.0,
    "members": [
      {
        "name": "total",
        "kind": "function",
        "file": "src/loops.rs",
        "line_start": 1,
        "line_end": 5
      },
      {
        "name": "amount",
        "kind": "function",
        "file": "src/loops.rs",
        "line_start": 7,
        "line_end": 11
      }
    ]
  }
]
[
  {
    "fingerprint": "a00c8803469ae2e9",
    "similarity": 0.95,
    "members": [
      {
        "name": "least",
        "kind": "function",
        "file": "src/less.rs",
        "line_start": 1,
        "line_end": 5
      },
      {
        "name": "count",
        "kind": "function",
        "file": "src/less.rs",
        "line_start": 7,
        "line_end": 11
      }
    ]
  }
]
[
  {
    "fingerprint": "2ceb754ec6023cd7",
    "similarity": 1.0,
    "members": [
      {
        "name": "for body",
        "kind": "loop body",
        "file": "src/loops.rs",
        "line_start": 1,
        "line_end": 5
      },
      {
        "name": "for body",
        "kind": "loop body",
        "file": "src/loops.rs",
        "line_start": 7,
        "line_end": 11
      }
    ]
  },
  {
    "fingerprint": "30b6815e8b56b97c",
    "similarity": 1.0,
    "members": [
      {
        "name": "if-then branch",
        "kind": "if branch",
        "file": "src/branches.rs",
        "line_start": 2,
        "line_end": 4
      },
      {
        "name": "if-then branch",
        "kind": "if branch",
        "file": "src/branches.rs",
        "line_start": 7,
        "line_end": 11
      }
    ]
  }
]
[
  {
    "fingerprint": "766603a6445b0b20",
    "similarity": 0.9166666666666666,
    "members": [
      {
        "name": "for body",
        "kind": "loop body",
        "file": "src/less.rs",
        "line_start": 1,
        "line_end": 5
      },
      {
        "name": "for body",
        "kind": "loop body",
        "file": "src/less.rs",
        "line_start": 7,
        "line_end": 11
      }
    ]
  }
]
""",
    "sample_check": """Duplication Statistics
=====================
Total code units analyzed: 7

Exact duplicates: 0 groups (0 code units)
Near duplicates:  1 groups (2 code units)

Duplicated lines (exact): 0
Duplicated lines (near):  10
Duplication: 0.0% exact, 30.3% near (of 33 total lines)

Check FAILED: 1 near duplicate groups (max: 0)
Near Duplicates
===============

Group 1 (fingerprint: a00c8803469ae2e9, similarity: 95%, 2 members):
  - least (function) at src/less.rs:1-5
  - count (function) at src/less.rs:7-11

Error: Check failed
""",
}


def printed_sql(name: str) -> str:
    lines = ", ".join("(" + str(i) + ", '" + line.replace("'", "''") + "')" for i, line in enumerate(PRINTED[name].split("\n"), 1))
    return f"SELECT line_no, line FROM (VALUES {lines}) AS t(line_no, line)"
