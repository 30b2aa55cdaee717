"""A tolerant parser for a small script language with braces, as concrete trees, and its grammar.

It shows what a mapped language needs: a parser that never fails, one table, and if wanted a query.  What cannot be read
becomes an ``ERROR`` node that ends at the next semicolon or brace, and the rest of the file is still parsed.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .captures import parse_queries
from .mapping import BLOCK, Cst, Defines, Grammar, Infix, Leaf, Name, Prefix, Shape, mapped_analyzer

_TOKEN = re.compile(r"""(?P<space>\s+|//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))|(?P<number>\d+(?:\.\d+)?)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<word>[^\W\d]\w*)|(?P<sign>=>|[=!]==?|[<>]=|&&|\|\||[-+*/%]=|[-+*/%<>=!(){}\[\];,.:]|.)""", re.S)

# Binary operators by precedence, loosest first, and the words of the language.
PRECEDENCE = (("||",), ("&&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%"))
BINARY = {"||": "Or", "&&": "And", "==": "Eq", "===": "Eq", "!=": "Ne", "!==": "Ne", "<": "Lt", ">": "Gt", "<=": "Le", ">=": "Ge", "+": "Add", "-": "Sub", "*": "Mul", "/": "Div", "%": "Rem"}
UPDATES = {"+=": "AddAssign", "-=": "SubAssign", "*=": "MulAssign", "/=": "DivAssign", "%=": "RemAssign"}
UNARY = {"-": "Neg", "!": "Not"}
CONSTANTS = {"true": "boolean", "false": "boolean", "null": "null"}
KEYWORDS = frozenset("function if else while for of return break continue let const var".split()) | CONSTANTS.keys()


class _Unreadable(Exception):
    pass


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, int]] = []
        line = 1
        for m in _TOKEN.finditer(text):
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0], line))
            line += m[0].count("\n")
        self.tokens.append(("end", "", line))
        self.at = 0

    @property
    def text(self) -> str:
        return self.tokens[self.at][1] if self.tokens[self.at][0] in ("word", "sign") else ""

    def take(self, *texts: str) -> str:
        if self.text and self.text in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return ""

    def need(self, text: str) -> None:
        if not self.take(text):
            raise _Unreadable

    def made(self, kind: str, first: int, children: list[Cst] = (), **fields: Cst | None) -> Cst:
        held = {k: v for k, v in fields.items() if v is not None}
        return Cst(kind, "", [*children, *held.values()], held, True, self.tokens[first][2], self.tokens[max(self.at - 1, first)][2])

    def leaf(self, kind: str, named: bool = True) -> Cst:
        _, text, line = self.tokens[self.at]
        self.at += 1
        return Cst(kind, text, named=named, line_start=line, line_end=line)

    def identifier(self) -> Cst:
        kind, text, _ = self.tokens[self.at]
        if kind != "word" or text in KEYWORDS:
            raise _Unreadable
        return self.leaf("identifier")

    def listed(self, kind: str, item: Callable[[], Cst], close: str) -> Cst:
        first, items = self.at - 1, []
        while not self.take(close):
            items.append(item())
            if not self.take(","):
                self.need(close)
                break
        return self.made(kind, first, items)

    def parenthesis(self) -> Cst:
        self.need("(")
        inside = self.expression()
        self.need(")")
        return inside

    # -- statements

    def program(self) -> Cst:
        return self.made("program", 0, self.statements(("end", "")))

    def statements(self, stop: tuple[str, str]) -> list[Cst]:
        out = []
        while self.tokens[self.at][0] != "end" and self.tokens[self.at][:2] != stop:
            first = self.at
            try:
                out.append(self.statement())
            except (_Unreadable, RecursionError):
                out.append(self.skipped(first))
        return out

    def skipped(self, first: int) -> Cst:
        """From where a statement began to the end of what broke it: a semicolon, or a closing brace of its own."""
        self.at, depth = max(self.at, first), 0
        for kind, text, _ in self.tokens[first : self.at]:
            depth += (kind == "sign") * ((text == "{") - (text == "}"))
        while self.tokens[self.at][0] != "end":
            text = self.text
            if text == "}" and depth <= 0 and self.at > first:
                break
            self.at += 1
            depth += (text == "{") - (text == "}")
            if depth <= 0 and text in (";", "}"):
                break
        return self.made("ERROR", first)

    def block(self) -> Cst:
        first = self.at
        self.need("{")
        inside = self.statements(("sign", "}"))
        self.need("}")
        return self.made("block", first, inside)

    def function(self, first: int, name: Cst | None) -> Cst:
        self.need("(")
        parameters = self.listed("parameters", self.identifier, ")")
        return self.made("function_definition" if name else "function_expression", first, name=name, parameters=parameters, body=self.block())

    def statement(self) -> Cst:
        first = self.at
        if self.text == "{":
            return self.block()
        if self.take("function"):
            return self.function(first, self.identifier())
        if self.take("if"):
            condition, then = self.parenthesis(), self.statement()
            return self.made("if_statement", first, condition=condition, consequence=then, alternative=self.statement() if self.take("else") else None)
        if self.take("while"):
            condition = self.parenthesis()
            return self.made("while_statement", first, condition=condition, body=self.statement())
        if self.take("for"):
            self.need("(")
            self.take("let", "const", "var")
            left = self.identifier()
            self.need("of")
            right = self.expression()
            self.need(")")
            return self.made("for_statement", first, left=left, right=right, body=self.statement())
        if word := self.take("return", "break", "continue"):
            value = [self.expression()] if word == "return" and self.text not in (";", "}") else []
            out = (f"{word}_statement", value, {})
        elif self.take("let", "const", "var"):
            left = self.identifier()
            out = ("assignment", [], {"left": left, "right": self.expression() if self.take("=") else None})
        else:
            out = ("", [self.expression()], {})
        if self.text != "}":
            self.need(";")
        return self.made(out[0], first, out[1], **out[2]) if out[0] else out[1][0]

    # -- expressions

    def expression(self) -> Cst:
        first, left = self.at, self.operation(0)
        if self.take("="):
            return self.made("assignment", first, left=left, right=self.expression())
        if self.text in UPDATES:
            sign = self.leaf("operator", named=False)
            return self.made("binary", first, [sign], left=left, right=self.expression())
        return left

    def operation(self, level: int) -> Cst:
        if level == len(PRECEDENCE):
            return self.unary()
        first, left = self.at, self.operation(level + 1)
        while self.text in PRECEDENCE[level]:
            sign = self.leaf("operator", named=False)
            left = self.made("binary", first, [sign], left=left, right=self.operation(level + 1))
        return left

    def unary(self) -> Cst:
        first = self.at
        if self.text in UNARY:
            sign = self.leaf("operator", named=False)
            return self.made("unary", first, [sign], argument=self.unary())
        out = self.primary()
        while sign := self.take("(", "[", "."):
            if sign == "(":
                out = self.made("call", first, function=out, arguments=self.listed("arguments", self.expression, ")"))
            elif sign == ".":
                out = self.made("member", first, object=out, property=self.identifier())
            else:
                index = self.expression()
                self.need("]")
                out = self.made("subscript", first, object=out, index=index)
        return out

    def primary(self) -> Cst:
        first, (kind, text, _) = self.at, self.tokens[self.at]
        if kind in ("number", "string") or text in CONSTANTS:
            return self.leaf(CONSTANTS.get(text, kind) if kind == "word" else "float" if "." in text and kind == "number" else kind)
        if self.take("function"):
            return self.function(first, None)
        if self.take("["):
            return self.listed("array", self.expression, "]")
        if self.take("("):
            at = self.at
            try:
                parameters = self.listed("parameters", self.identifier, ")")
                self.need("=>")
            except _Unreadable:
                self.at = at
                inside = self.expression()
                self.need(")")
                return inside
            return self.made("function_expression", first, parameters=parameters, body=self.block() if self.text == "{" else self.expression())
        return self.identifier()


def parse(text: str) -> Cst:
    return _Parser(text).program()


GRAMMAR = Grammar({
    "identifier": Name(),
    "number": Leaf("Literal", "Int"), "float": Leaf("Literal", "Float"), "string": Leaf("Literal", "Str"), "boolean": Leaf("Literal", "Bool"), "null": Leaf("Literal", "Null"),
    ("program", "block", "parameters"): BLOCK,
    "array": Shape("Array"),
    "binary": Infix(BINARY | UPDATES), "unary": Prefix(UNARY),
    "assignment": Shape("Assign", ("left", "right")),
    "call": Shape("Call", ("function", "arguments/*")), "member": Shape("FieldAccess", ("object", "property")), "subscript": Shape("Index", ("object", "index")),
    "if_statement": Shape("If", ("condition", "consequence", "alternative")),
    "while_statement": Shape("While", ("condition", "body")), "for_statement": Shape("ForLoop", ("left", "right", "body")),
    "return_statement": Shape("Return"), "break_statement": Shape("Break"), "continue_statement": Shape("Continue"),
    "function_definition": Defines("function"), "function_expression": Defines("closure", Shape("Closure", ("body", "parameters/*"))),
})

UNITS = parse_queries("""
    (function_definition name: (identifier) @name parameters: (parameters) @parameters body: (block) @body) @function
    (function_expression parameters: (parameters) @parameters body: (_) @body) @closure
""")

ANALYZER = mapped_analyzer("braces", ("bs",), parse, GRAMMAR, UNITS, lambda kind, name: name.startswith("test"))
