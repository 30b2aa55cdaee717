"""Python front-end: functions, lambdas and classes of a module, by the standard library's ``ast``.

Trees have the shapes that the public concrete grammar gives: wrappers with one child vanish, other constructs
without a shape of their own become blocks, all names share one counter.
"""

from __future__ import annotations

import ast
import re

from .tree import Node, Numbering, Unit, leaf, name_leaf, node, none, opt

# Operators by ast class.
BINARY = {"Add": "Add", "Sub": "Sub", "Mult": "Mul", "Div": "Div", "Mod": "Rem", "BitXor": "BitXor", "BitAnd": "BitAnd", "BitOr": "BitOr", "LShift": "Shl", "RShift": "Shr", "FloorDiv": "FloorDiv", "Pow": "Pow"}
COMPARE = {"Eq": "Eq", "Lt": "Lt", "LtE": "Le", "NotEq": "Ne", "GtE": "Ge", "Gt": "Gt", "In": "In", "NotIn": "NotIn", "Is": "Is", "IsNot": "IsNot"}
UNARY = {"Not": "Not", "USub": "Neg"}


_PARENS = re.compile(rb"\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|#[^\n]*|[()]")


def _collapse(kids: list[Node]) -> Node:
    """A construct without a shape of its own: nothing, its only child, or a block."""
    return leaf("Opaque") if not kids else kids[0] if len(kids) == 1 else node("Block", *kids)


def _var(name: str) -> Node:
    return name_leaf("Variable", name)


class _Shapes(ast.NodeVisitor):
    def __init__(self, lines: list[bytes]):
        self.lines = lines

    def many(self, xs) -> list[Node]:
        return [self.visit(x) for x in xs if x is not None]

    def block(self, body) -> Node:
        return node("Block", *self.many(body))

    def _text_at(self, x: ast.AST) -> bytes:
        return self.lines[x.lineno - 1][x.col_offset :] if x.lineno <= len(self.lines) else b""

    # -- statements

    def visit_Expr(self, x):
        return self.visit(x.value)

    def visit_Assign(self, x):
        out = self.visit(x.value)
        for target in reversed(x.targets):
            out = node("Assign", self.target(target), out)
        return out

    def target(self, x):
        if isinstance(x, (ast.Tuple, ast.List)):
            return _collapse([self.target(e) for e in x.elts])
        return self.visit(x)

    def visit_AnnAssign(self, x):
        return node("Assign", self.visit(x.target), opt(x.value and self.visit(x.value)))

    def visit_AugAssign(self, x):
        kind = BINARY.get(type(x.op).__name__)
        return node("BinaryOp", self.visit(x.target), self.visit(x.value), data=f"{kind}Assign" if kind else "Other")

    def visit_Return(self, x):
        return node("Return", *self.many([x.value]))

    def visit_Pass(self, x):
        return leaf("Opaque")

    def visit_Break(self, x):
        return leaf("Break")

    def visit_Continue(self, x):
        return leaf("Continue")

    def visit_If(self, x):
        other = None
        if len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If) and self._text_at(x.orelse[0]).startswith(b"elif"):
            other = node("Block", self.visit(x.orelse[0].test), self.block(x.orelse[0].body))
        elif x.orelse:
            other = self.block(x.orelse)
        return node("If", self.visit(x.test), self.block(x.body), opt(other))

    def visit_For(self, x):
        return node("ForLoop", self.target(x.target), self.visit(x.iter), self.block(x.body))

    visit_AsyncFor = visit_For

    def visit_While(self, x):
        return node("While", self.visit(x.test), self.block(x.body))

    def visit_With(self, x):
        items = [_collapse(self.many([i.context_expr]) + ([self.target(i.optional_vars)] if i.optional_vars else [])) for i in x.items]
        return node("Block", _collapse(items), self.block(x.body))

    visit_AsyncWith = visit_With

    def visit_Try(self, x):
        kids = [self.block(x.body)]
        for h in x.handlers:
            caught = self.many([h.type]) + ([_var(h.name)] if h.name else [])
            kids.append(_collapse(([_collapse(caught)] if caught else []) + [self.block(h.body)]))
        return _collapse(kids + [self.block(b) for b in (x.orelse, x.finalbody) if b])

    visit_TryStar = visit_Try

    def visit_Raise(self, x):
        return _collapse(self.many([x.exc, x.cause]))

    def visit_Assert(self, x):
        return _collapse(self.many([x.test, x.msg]))

    def visit_Delete(self, x):
        return _collapse([self.target(t) for t in x.targets])

    def visit_Global(self, x):
        return _collapse([_var(n) for n in x.names])

    visit_Nonlocal = visit_Global

    def _dotted(self, name: str) -> Node:
        return leaf("Opaque") if name == "*" else _collapse([_var(n) for n in name.split(".") if n])

    def _alias(self, x: ast.alias) -> Node:
        return node("Block", self._dotted(x.name), _var(x.asname)) if x.asname else self._dotted(x.name)

    def visit_Import(self, x):
        return _collapse([self._alias(a) for a in x.names])

    def visit_ImportFrom(self, x):
        return _collapse([self._dotted(x.module or ""), *map(self._alias, x.names)])

    def visit_FunctionDef(self, x):
        return node("Block", _var(x.name), self.parameters(x.args), *self.many([x.returns]), self.block(x.body))

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, x):
        above = [_collapse(self.many(x.bases) + [self.visit(k) for k in x.keywords])] if x.bases or x.keywords else []
        return node("Block", _var(x.name), *above, self.block(x.body))

    def visit_Match(self, x):
        return node("Match", self.visit(x.subject), *[node("MatchArm", self.visit(c.pattern), opt(c.guard and self.visit(c.guard)), self.block(c.body)) for c in x.cases])

    # -- parameters

    def parameters(self, a: ast.arguments) -> Node:
        plain = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
        kids = []
        for i, (arg, default) in enumerate(zip(plain, defaults, strict=True)):
            kids.append(self._parameter(arg, default))
            if i + 1 == len(a.posonlyargs):
                kids.append(leaf("Opaque"))
        if a.vararg:
            kids.append(self._parameter(a.vararg, None))
        elif a.kwonlyargs:
            kids.append(leaf("Opaque"))
        kids += [self._parameter(arg, default) for arg, default in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        if a.kwarg:
            kids.append(self._parameter(a.kwarg, None))
        return _collapse(kids)

    def _parameter(self, arg: ast.arg, default) -> Node:
        return _collapse([_var(arg.arg), *self.many([arg.annotation, default])])

    # -- expressions

    def visit_Name(self, x):
        return _var(x.id)

    def visit_Constant(self, x):
        kinds = {bool: "Bool", int: "Int", float: "Float", complex: "Float", str: "Str", bytes: "Str", type(None): "Null"}
        kind = kinds.get(type(x.value))
        return leaf("Literal", kind) if kind else leaf("Opaque")

    def visit_JoinedStr(self, x):
        return leaf("Literal", "Str")

    visit_TemplateStr = visit_JoinedStr

    def visit_BinOp(self, x):
        return node("BinaryOp", self.visit(x.left), self.visit(x.right), data=BINARY.get(type(x.op).__name__, "Other"))

    def visit_BoolOp(self, x):
        first, *rest = self.many(x.values)
        for right in rest:
            first = node("BinaryOp", first, right, data=type(x.op).__name__)
        return first

    def visit_UnaryOp(self, x):
        return node("UnaryOp", self.visit(x.operand), data=UNARY.get(type(x.op).__name__, "Other"))

    def visit_Compare(self, x):
        kind = COMPARE.get(type(x.ops[0]).__name__, "Other")
        *front, out = self.many([x.left, *x.comparators])
        for left in reversed(front):
            out = node("BinaryOp", left, out, data=kind)
        return out

    def visit_Call(self, x):
        if len(x.args) == 1 and isinstance(x.args[0], ast.GeneratorExp) and not x.keywords and x.args[0].end_col_offset == x.end_col_offset:
            return node("Call", self.visit(x.func), *self._comprehension(x.args[0], [x.args[0].elt]))
        args = sorted([*x.args, *x.keywords], key=lambda a: (a.lineno, a.col_offset) if not isinstance(a, ast.keyword) else (a.value.lineno, a.value.col_offset))
        return node("Call", self.visit(x.func), *self.many(args))

    def visit_keyword(self, x):
        return node("Block", _var(x.arg), self.visit(x.value)) if x.arg else self.visit(x.value)

    def visit_Attribute(self, x):
        return node("FieldAccess", self.visit(x.value), _var(x.attr))

    def visit_Subscript(self, x):
        inner = x.slice.elts if isinstance(x.slice, ast.Tuple) and not self._text_at(x.slice).startswith(b"(") else [x.slice]
        return node("Index", self.visit(x.value), *self.many(inner))

    def visit_Slice(self, x):
        return _collapse(self.many([x.lower, x.upper, x.step]))

    def visit_Lambda(self, x):
        a = x.args
        has = a.posonlyargs or a.args or a.vararg or a.kwonlyargs or a.kwarg
        return _collapse(([self.parameters(a)] if has else []) + [self.visit(x.body)])

    def visit_IfExp(self, x):
        return node("Block", *self.many([x.body, x.test, x.orelse]))

    def _comprehension(self, x, heads) -> list[Node]:
        kids = [_collapse(self.many(heads))]
        for g in x.generators:
            kids.append(node("Block", self.target(g.target), self.visit(g.iter)))
            kids += self.many(g.ifs)
        return kids

    def visit_ListComp(self, x):
        return _collapse(self._comprehension(x, [x.elt]))

    visit_SetComp = visit_GeneratorExp = visit_ListComp

    def visit_DictComp(self, x):
        return _collapse(self._comprehension(x, [x.key, x.value]))

    def visit_Tuple(self, x):
        kids = self.many(x.elts)
        return node("Tuple", *kids) if self._wrapped(x) else _collapse(kids)

    def _wrapped(self, x: ast.Tuple) -> bool:
        """Whether the tuple has parentheses of its own: the one at its start closes at its end."""
        text = b"\n".join(self.lines[x.lineno - 1 : x.end_lineno - 1] + [self.lines[x.end_lineno - 1][: x.end_col_offset]])[x.col_offset :]
        depth = 0
        for m in _PARENS.finditer(text):
            depth += (m[0] == b"(") - (m[0] == b")")
            if not depth and m[0] == b")":
                return text.startswith(b"(") and m.end() == len(text)
        return False

    def visit_List(self, x):
        return node("Array", *self.many(x.elts))

    def visit_Set(self, x):
        return node("Set", *self.many(x.elts))

    def visit_Dict(self, x):
        return node("StructInit", *[node("Block", self.visit(k), self.visit(v)) if k else self.visit(v) for k, v in zip(x.keys, x.values, strict=True)])

    def visit_Await(self, x):
        return node("Await", self.visit(x.value))

    def visit_Yield(self, x):
        return node("Yield", *self.many([x.value]))

    visit_YieldFrom = visit_Yield

    def visit_Starred(self, x):
        return self.visit(x.value)

    def visit_NamedExpr(self, x):
        return node("Block", self.visit(x.target), self.visit(x.value))

    def visit_MatchAs(self, x):
        return _collapse(self.many([x.pattern]) + ([_var(x.name)] if x.name else []))

    def visit_MatchStar(self, x):
        return _var(x.name) if x.name else leaf("Opaque")

    def generic_visit(self, x):
        return _collapse(self.many(k for k in ast.iter_child_nodes(x) if not isinstance(k, ast.expr_context)))


def _units_of(tree: ast.AST, path: str, lines: list[bytes]) -> list[Unit]:
    shapes, out = _Shapes(lines), []
    stack = [tree]
    while stack:
        x = stack.pop()
        kind = None
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            kind, name, signature, body = "function", x.name, shapes.parameters(x.args), shapes.block(x.body)
            is_test = name.startswith("test_")
        elif isinstance(x, ast.Lambda):
            a = x.args
            has = a.posonlyargs or a.args or a.vararg or a.kwonlyargs or a.kwarg
            kind, name, is_test = "closure", f"anonymous at {path}:{x.lineno}", False
            signature, body = shapes.parameters(a) if has else none(), shapes.visit(x.body)
        elif isinstance(x, ast.ClassDef):
            kind, name, signature, body = "class", x.name, none(), shapes.block(x.body)
            is_test = name.startswith("Test")
        if kind:
            numbers = Numbering()
            out.append(Unit(kind, name, x.lineno, x.end_lineno, numbers.resolve(signature), numbers.resolve(body), is_test))
        place = lambda k: (getattr(k, "lineno", 0), getattr(k, "col_offset", 0))
        stack.extend(sorted(ast.iter_child_nodes(x), key=place, reverse=True))
    return out


def _valid_parts(text: str) -> list[ast.Module]:
    """Top-level blocks of a broken file that parse by themselves, at their own line numbers."""
    lines = text.split("\n")
    starts = [i for i, line in enumerate(lines) if line[:1].strip() and line[0] not in "#)]}"] or [0]
    parts = []
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
        try:
            parts.append(ast.parse("\n" * a + "\n".join(lines[a:b])))
        except (SyntaxError, ValueError):
            pass
    return parts


def python_units(path: str, text: str) -> list[Unit]:
    """Units in order of position.  Syntax errors do not fail a file: its valid top-level blocks are used."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    try:
        trees = [ast.parse(text)]
    except (SyntaxError, ValueError):
        trees = _valid_parts(text)
    return [u for t in trees for u in _units_of(t, path, lines)]
