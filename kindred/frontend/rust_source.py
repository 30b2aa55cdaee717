"""Rust front-end: a lexer and a precedence parser that build normalized trees directly.

Functions, methods of ``impl`` blocks and closures become units in order of position.  Anything the normal form has
no shape for becomes an opaque leaf; a file that does not parse fails as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from .tree import Node, Numbering, Unit, leaf, name_leaf, node, none, opt


class RustSyntaxError(ValueError):
    pass


@dataclass(slots=True)
class Token:
    kind: str  # id, life, lit, p, end
    text: str
    line: int
    last: int
    joint: bool = False


# Binary operators by precedence, loosest first.
PRECEDENCE = (("||",), ("&&",), ("==", "!=", "<=", ">=", "<", ">"), ("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))
OPERATORS = {"+": "Add", "-": "Sub", "*": "Mul", "/": "Div", "%": "Rem", "&&": "And", "||": "Or", "^": "BitXor", "&": "BitAnd", "|": "BitOr", "<<": "Shl", ">>": "Shr", "==": "Eq", "<": "Lt", "<=": "Le", "!=": "Ne", ">=": "Ge", ">": "Gt"}
ASSIGNING = {"+=": "AddAssign", "-=": "SubAssign", "*=": "MulAssign", "/=": "DivAssign", "%=": "RemAssign", "^=": "BitXorAssign", "&=": "BitAndAssign", "|=": "BitOrAssign", "<<=": "ShlAssign", ">>=": "ShrAssign"}
UNARY = {"*": "Deref", "!": "Not", "-": "Neg"}
KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())
ITEM_WORDS = frozenset("fn struct enum impl trait mod use type static extern macro_rules union pub".split())

_LEVEL = {op: i for i, ops in enumerate(PRECEDENCE) for op in ops}
_LONGEST = sorted([*_LEVEL, *ASSIGNING], key=len, reverse=True)
_CAST = len(PRECEDENCE)

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*)|(?P<comment>/\*)
    |(?P<raw>(?:b|c)?r(?P<hash>\#*)"(?s:.*?)"(?P=hash))
    |(?P<str>(?:b|c)?"(?:[^"\\]|\\(?s:.))*")
    |(?P<char>b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.))')
    |(?P<life>'(?:r\#)?[^\W\d]\w*)
    |(?P<num>0[xob][0-9a-fA-F_]+\w*|[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?\w*(?:\.(?![.\w]))?)
    |(?P<id>(?:r\#)?[^\W\d]\w*)
    |(?P<p>[-+*/%^!&|=<>@.,;:\#$?~\\(){}\[\]])""",
    re.X,
)


def _literal_kind(text: str, group: str) -> str:
    if group in ("raw", "str"):
        return {"b": "ByteStr", "c": "CStr"}.get(text[0], "Str")
    if group == "char":
        return "Byte" if text[0] == "b" else "Char"
    if re.match(r"0[xob]", text):
        return "Int"
    return "Float" if re.search(r"\.|f32$|f64$|^[0-9_]+[eE]", text) else "Int"


def tokenize(text: str) -> list[Token]:
    out: list[Token] = []
    at, line = 0, 1
    if text.startswith("#!") and not text.startswith("#!["):
        at = text.find("\n") if "\n" in text else len(text)
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise RustSyntaxError(f"line {line}: unexpected character {text[at]!r}")
        group, body = m.lastgroup, m[0]
        if group == "comment":
            depth, to = 1, at + 2
            while depth:
                n = re.compile(r"/\*|\*/").search(text, to)
                if not n:
                    raise RustSyntaxError(f"line {line}: unterminated comment")
                depth, to = depth + (1 if n[0] == "/*" else -1), n.end()
            line, at = line + text.count("\n", at, to), to
            continue
        if group == "hash":
            group = "raw"
        last = line + body.count("\n")
        if group in ("raw", "str", "char", "num"):
            out.append(Token("lit", _literal_kind(body, group) + ":" + body, line, last))
        elif group == "p":
            nxt = text[m.end() : m.end() + 1]
            out.append(Token("p", body, line, line, bool(nxt) and nxt in "-+*/%^!&|=<>.:" or nxt == "#"))
        elif group != "space":
            out.append(Token(group, body.removeprefix("r#"), line, line))
        line, at = last, m.end()
    out.append(Token("end", "", line, line))
    return out


class _Parser:
    def __init__(self, tokens: list[Token], path: str = "", units: list | None = None):
        self.t, self.i, self.path = tokens, 0, path
        self.units = units  # None: nothing is collected here
        self.test = False

    # -- tokens

    @property
    def now(self) -> Token:
        return self.t[self.i]

    def fail(self, what: str):
        raise RustSyntaxError(f"line {self.now.line}: expected {what}, found {self.now.text or 'end of file'!r}")

    def at(self, s: str, ahead: int = 0) -> bool:
        """Whether punctuation s, or word s, comes next."""
        i = self.i + ahead
        if s[0].isalpha() or s[0] == "_":
            return i < len(self.t) and self.t[i].kind == "id" and self.t[i].text == s
        for n, c in enumerate(s):
            if i + n >= len(self.t) or self.t[i + n].kind != "p" or self.t[i + n].text != c or (n < len(s) - 1 and not self.t[i + n].joint):
                return False
        return True

    def eat(self, s: str) -> bool:
        if self.at(s):
            self.i += 1 if s[0].isalpha() or s[0] == "_" else len(s)
            return True
        return False

    def need(self, s: str) -> None:
        if not self.eat(s):
            self.fail(repr(s))

    def word(self) -> str:
        if self.now.kind != "id":
            self.fail("an identifier")
        self.i += 1
        return self.t[self.i - 1].text

    def balanced(self) -> tuple[int, int]:
        """Skip a bracketed group; the range of its inner tokens."""
        pairs, stack, start = {"(": ")", "[": "]", "{": "}"}, [], self.i + 1
        while True:
            x = self.now
            if x.kind == "end":
                self.fail("a closing bracket")
            if x.kind == "p" and x.text in pairs:
                stack.append(pairs[x.text])
            elif x.kind == "p" and x.text in ")]}":
                if not stack or stack.pop() != x.text:
                    self.fail("a matching bracket")
            self.i += 1
            if not stack:
                return start, self.i - 1

    def angles(self) -> None:
        """Skip generic parameters or arguments, after their opening mark came up."""
        depth = 0
        while True:
            if self.now.kind == "end":
                self.fail("'>'")
            if self.now.kind == "p" and self.now.text in "([{":
                self.balanced()
                continue
            arrow = self.at("->") or self.at("=>")
            if arrow:
                self.i += 2
                continue
            depth += (self.at("<")) - (self.at(">"))
            self.i += 1
            if not depth:
                return

    def attributes(self) -> list[list[Token]]:
        out = []
        while self.at("#") and (self.at("[", 1) or (self.at("!", 1) and self.at("[", 2))):
            self.i += 1
            inner = self.eat("!")
            a, b = self.balanced()
            if not inner:
                out.append(self.t[a:b])
        return out

    @staticmethod
    def _says(attrs: list[list[Token]], *texts: str) -> bool:
        return any([x.text for x in a] == list(texts) for a in attrs)

    # -- items

    def items(self, stop: str | None = None) -> None:
        while not (self.at(stop) if stop else self.now.kind == "end"):
            if not self.item(self.attributes()):
                if self.now.kind == "end" or not self.eat(";"):
                    self.fail("an item")

    def skip_to_end(self) -> None:
        """To behind the next ``;`` or block of this item, visiting the expressions of neither."""
        while not self.eat(";"):
            if self.now.kind == "end":
                self.fail("';'")
            if self.at("{"):
                self.balanced()
                return
            self.balanced() if self.now.kind == "p" and self.now.text in "([" else self._one()

    def _one(self) -> None:
        self.i += 1

    def is_item(self) -> bool:
        x, y = self.now, self.t[min(self.i + 1, len(self.t) - 1)]
        if x.kind != "id":
            return False
        if x.text == "union":
            return y.kind == "id"
        if x.text == "macro_rules":
            return y.text == "!"
        if x.text == "const":
            return y.kind == "id" and y.text not in ("move", "async") or y.text == "_" and not self.at("{", 1)
        if x.text == "unsafe":
            return y.kind == "id" and y.text in ("fn", "impl", "trait", "extern", "mod")
        if x.text == "async":
            return y.kind == "id" and y.text in ("fn", "unsafe", "extern")
        if x.text == "static":
            return not (y.text in ("|", "move"))
        return x.text in ITEM_WORDS

    def item(self, attrs: list[list[Token]]) -> bool:
        """Parse one item if there is one; its units are collected on the way."""
        if not self.is_item():
            if self.units is not None and self.now.kind == "id" and (self.at("!", 1) or self.at("::", 1)):
                return self._item_macro()
            return False
        if self.eat("pub") and self.at("("):
            self.balanced()
        tested, under_test = self._says(attrs, "test"), self._says(attrs, "cfg", "(", "test", ")")
        before = self.test
        while self.now.text in ("const", "async", "unsafe", "extern", "default") and self.now.kind == "id" and not self._const_value():
            self.i += 1
            if self.now.kind == "lit":
                self.i += 1
            if self.at("{"):  # extern block
                self.balanced()
                return True
            if self.at("crate"):
                self.skip_to_end()
                return True
        if self.at("fn"):
            self.test = before or tested or under_test
            self.function("function")
        elif self.eat("mod"):
            self.word()
            if not self.eat(";"):
                self.need("{")
                self.test = before or under_test
                self.items("}")
                self.need("}")
        elif self.at("impl"):
            self.test = before or under_test
            self.impl()
        elif self.eat("trait"):
            while not self.at("{") and not self.at(";"):
                self.angles() if self.at("<") else self._one()
            if not self.eat(";"):
                self.need("{")
                while not self.eat("}"):
                    self.attributes()
                    self.member(None)
        elif self.eat("macro_rules"):
            self.need("!")
            self.word()
            braces = self.at("{")
            self.balanced()
            if not braces:
                self.eat(";")
        elif self.now.text in ("const", "static"):
            self.value_item()
        elif self.now.text == "use":
            while not self.eat(";"):
                self.balanced() if self.at("{") else self._one() if self.now.kind != "end" else self.fail("';'")
        else:
            self.skip_to_end()
        self.test = before
        return True

    def _const_value(self) -> bool:
        """``const NAME: T`` as opposed to ``const fn``."""
        y = self.t[self.i + 1]
        return self.now.text == "const" and not (y.kind == "id" and y.text in ("fn", "async", "unsafe", "extern"))

    def value_item(self) -> None:
        self.i += 1
        self.eat("mut")
        self.word()
        if self.eat(":"):
            self.type()
        if self.eat("="):
            self.expr()
        self.need(";")

    def _item_macro(self) -> bool:
        while self.now.kind == "id" and self.at("::", 1):
            self.i += 3
        if not (self.now.kind == "id" and self.at("!", 1)):
            return False
        self.i += 2
        if self.now.kind == "id":
            self.i += 1
        braces = self.at("{")
        self.balanced()
        if not braces:
            self.need(";")
        return True

    def signature(self) -> tuple[str, int, Node]:
        self.need("fn")
        line, name = self.now.line, self.word()
        if self.at("<"):
            self.angles()
        self.need("(")
        params: list[Node] = []
        while not self.eat(")"):
            self.attributes()
            params.append(self.parameter())
            if not self.at(")"):
                self.need(",")
        result = self.type() if self.eat("->") else None
        if self.at("where"):
            while not self.at("{") and not self.at(";"):
                self.angles() if self.at("<") else self.balanced() if self.now.text in ("(", "[") and self.now.kind == "p" else self._one()
        return name, line, node("FnSignature", opt(result), *params)

    def parameter(self) -> Node:
        start = self.i
        reference = self.eat("&")
        if reference and self.now.kind == "life":
            self.i += 1
        mutable = self.eat("mut")
        if self.at("self") and not self.at("::", 1):
            self.i += 1
            if self.eat(":"):
                self.type()
            me = name_leaf("Variable", "self")
            return node("Reference", me, data="mut" if mutable else "") if reference else me
        self.i = start
        if self.at("..."):
            self.i += 3
            return leaf("Opaque")
        pattern = self.pattern()
        self.need(":")
        return node("FieldValue", pattern, self.type())

    def function(self, kind: str, owner: str = "") -> None:
        slot = self._slot()
        name, line, signature = self.signature()
        if self.eat(";"):
            self._fill(slot, None)
            return
        body, last = self.block()
        self._fill(slot, lambda: self._unit(kind, owner.format(name) if owner else name, line, last, signature, body), self.test)

    def _slot(self):
        if self.units is None:
            return None
        self.units.append(None)
        return len(self.units) - 1

    def _fill(self, slot, make: Callable[[], Unit] | None, test: bool = False) -> None:
        if slot is not None and make is not None:
            self.units[slot] = make()
            self.units[slot].is_test = test

    @staticmethod
    def _unit(kind, name, line, last, signature, body) -> Unit:
        numbers = Numbering()
        return Unit(kind, name, line, last, numbers.resolve(signature), numbers.resolve(body))

    def impl(self) -> None:
        self.need("impl")
        if self.at("<"):
            self.angles()
        self.eat("const")
        self.eat("!")
        first = self._type_name()
        owner = first + "::{}"
        if self.eat("for"):
            owner = f"<{self._type_name()} as {first}>::{{}}"
        while not self.at("{"):
            self.angles() if self.at("<") else self._one() if self.now.kind != "end" else self.fail("'{'")
        self.need("{")
        kind = "trait impl block" if owner.startswith("<") else "method"
        while not self.eat("}"):
            self.attributes()
            self.member((kind, owner))

    def _type_name(self) -> str:
        """Segments of a path type joined by ``::``; ``Unknown`` for other types."""
        start = self.i
        if self.now.kind == "id" and self.now.text not in ("dyn", "impl", "fn", "unsafe", "extern") or self.at("::"):
            self.eat("::")
            names = [self.word()]
            while True:
                if self.at("<"):
                    self.angles()
                elif self.at("(") and names[-1].startswith("Fn"):
                    self.balanced()
                    if self.eat("->"):
                        self.type()
                if not self.eat("::"):
                    break
                if not self.at("<"):
                    names.append(self.word())
            if not self.at("!"):
                return "::".join(names)
        self.i = start
        self.type()
        return "Unknown"

    def member(self, owner: tuple[str, str] | None) -> None:
        """An item of an impl or trait.  Methods of impls are units without anything inside them; a trait's own methods
        are not units, but what lies in them is."""
        if self.eat("pub") and self.at("("):
            self.balanced()
        if self.at("default") and self.t[self.i + 1].kind == "id":
            self.i += 1
        while self.now.kind == "id" and self.now.text in ("const", "async", "unsafe", "extern") and not self._const_value():
            self.i += 1
            if self.now.kind == "lit":
                self.i += 1
        if not self.at("fn"):
            if self.now.kind == "id" and (self.at("!", 1) or self.at("::", 1)):
                self._item_macro()
            elif self.at("const") and owner is None:
                self.i += 1
                self.word()
                if self.eat(":"):
                    self.type()
                if self.eat("="):
                    self.expr()
                self.need(";")
            else:
                self.skip_to_end()
            return
        outer = self.units
        if owner:
            slot, self.units = self._slot(), None
        name, line, signature = self.signature()
        if self.eat(";"):
            self.units = outer
            return
        body, last = self.block()
        self.units = outer
        if owner:
            self._fill(slot, lambda: self._unit(owner[0], owner[1].format(name), line, last, signature, body), self.test)

    # -- statements

    def block(self) -> tuple[Node, int]:
        """The block and the line of its closing brace."""
        self.need("{")
        kids: list[Node] = []
        while not self.at("}"):
            kids.append(self.statement())
        last = self.now.line
        self.need("}")
        return node("Block", *kids), last

    def statement(self) -> Node:
        attrs = self.attributes()
        if self.eat(";"):
            return node("Semi", leaf("Opaque"))
        if self.is_item():
            self.item(attrs)
            return leaf("Opaque")
        if self.eat("let"):
            pattern, init, diverge = self.pattern(), None, None
            if self.eat(":"):
                self.type()
            if self.eat("="):
                init = self.expr()
                if self.eat("else"):
                    diverge = self.block()[0]
            self.need(";")
            return node("LetBinding", pattern, none(), opt(init), opt(diverge))
        start = self.i
        closed = self._block_like()
        x = self.expr_statement(closed)
        if self.eat(";"):
            return node("Semi", x)
        if self.at("}") or closed and self.t[self.i - 1].text == "}" and self.t[self.i - 1].kind == "p" and self.i > start:
            return x
        self.fail("';' or '}'")

    def _block_like(self) -> bool:
        x = self.now
        if x.kind == "life":
            return True
        if x.kind == "p":
            return x.text == "{"
        if x.kind == "id" and x.text in ("if", "match", "loop", "while", "for"):
            return True
        if x.kind == "id" and x.text in ("unsafe", "const", "async") and self.at("{", 1):
            return True
        i = self.i
        while self.t[i].kind == "id" and self.at("::", i + 1 - self.i):
            i += 3
        return self.t[i].kind == "id" and self.at("!", i + 1 - self.i) and not self.at("!=", i + 1 - self.i) and self.at("{", i + 2 - self.i)

    def expr_statement(self, closed: bool) -> Node:
        """Block-like expressions end a statement unless a method call or ``?`` follows."""
        if not closed:
            return self.expr()
        x = self.primary(False)
        if (self.at(".") and not self.at("..")) or self.at("?"):
            return self.assignment(False, self.binary(0, False, self.postfix(x, False)))
        return x

    # -- expressions

    def expr(self, no_struct: bool = False) -> Node:
        self.attributes()
        return self.assignment(no_struct, self.range_(no_struct))

    def assignment(self, no_struct: bool, left: Node) -> Node:
        if self.at("=") and not self.at("==") and not self.at("=>"):
            self.i += 1
            return node("Assign", left, self.expr(no_struct))
        for op, kind in ASSIGNING.items():
            if self.at(op) and not (len(op) == 2 and self.now.text in "<>"):
                self.i += len(op)
                return node("BinaryOp", left, self.expr(no_struct), data=kind)
        return left

    def _range_ends(self, no_struct: bool) -> bool:
        x = self.now
        return x.kind == "end" or x.kind == "p" and (x.text in ")]},;" or self.at("=>") or x.text == "{" and no_struct)

    def range_(self, no_struct: bool) -> Node:
        left = None
        if not self.at(".."):
            left = self.binary(0, no_struct)
            if not self.at(".."):
                return left
        self.i += 2
        self.eat("=")
        right = None if self._range_ends(no_struct) else self.binary(0, no_struct)
        return node("Range", opt(left), opt(right))

    def _operator(self) -> str | None:
        if self.now.kind != "p":
            return None
        for op in _LONGEST:
            if self.at(op):
                return op if op in _LEVEL and not self.at("=>") else None
        return None

    def binary(self, level: int, no_struct: bool, left: Node | None = None) -> Node:
        left = left if left is not None else self.unary(no_struct)
        while True:
            if self.at("as"):
                self.i += 1
                left = node("Cast", left, self.type(bounds=False))
                continue
            op = self._operator()
            if op is None or _LEVEL[op] < level:
                return left
            self.i += len(op)
            left = node("BinaryOp", left, self.binary(_LEVEL[op] + 1, no_struct), data=OPERATORS[op])

    def unary(self, no_struct: bool) -> Node:
        self.attributes()
        x = self.now
        if x.kind == "p" and x.text in UNARY:
            self.i += 1
            return node("UnaryOp", self._operand(no_struct), data=UNARY[x.text])
        if x.kind == "p" and x.text == "&":
            self.i += 1
            if self.at("raw") and self.t[self.i + 1].text in ("const", "mut") and self.t[self.i + 1].kind == "id":
                self.i += 2
                self._operand(no_struct)
                return leaf("Opaque")
            mutable = self.eat("mut")
            return node("Reference", self._operand(no_struct), data="mut" if mutable else "")
        return self.postfix(self.primary(no_struct), no_struct)

    def _operand(self, no_struct: bool) -> Node:
        return self.unary(no_struct)

    def arguments(self, close: str) -> list[Node]:
        out = []
        while not self.eat(close):
            out.append(self.expr())
            if not self.at(close):
                self.need(",")
        return out

    def postfix(self, x: Node, no_struct: bool) -> Node:
        while True:
            if self.eat("?"):
                x = node("Try", x)
            elif self.at("("):
                self.i += 1
                x = node("Call", x, *self.arguments(")"))
            elif self.at("["):
                self.i += 1
                index = self.expr()
                self.need("]")
                x = node("Index", x, index)
            elif self.at(".") and not self.at(".."):
                self.i += 1
                if self.eat("await"):
                    x = node("Await", x)
                elif self.now.kind == "lit":
                    for part in self.now.text.partition(":")[2].rstrip(".").split("."):
                        x = node("FieldAccess", x, name_leaf("Variable", part), order=(1, 0))
                    self.i += 1
                else:
                    name = self.word()
                    if self.at("::"):
                        self.i += 2
                        self.angles()
                    if self.eat("("):
                        x = node("MethodCall", x, name_leaf("Function", name), *self.arguments(")"), order=(1, 0))
                    else:
                        x = node("FieldAccess", x, name_leaf("Variable", name), order=(1, 0))
            else:
                return x

    def primary(self, no_struct: bool) -> Node:
        x = self.now
        if x.kind == "lit":
            self.i += 1
            return leaf("Literal", x.text.partition(":")[0])
        if x.kind == "life":
            self.i += 1
            self.need(":")
            return self.primary(no_struct)
        if x.kind == "p":
            return self._bracketed(x)
        if x.kind == "end":
            self.fail("an expression")
        handler = getattr(self, f"word_{x.text}", None)
        if handler:
            found = handler(no_struct)
            if found is not None:
                return found
        if x.text in KEYWORDS and x.text not in ("self", "Self", "super", "crate"):
            self.fail("an expression")
        return self.path_expr(no_struct)

    def _bracketed(self, x: Token) -> Node:
        if x.text == "(":
            self.i += 1
            if self.eat(")"):
                return node("Tuple")
            kids = [self.expr()]
            if self.eat(")"):
                return node("Paren", kids[0])
            self.need(",")
            return node("Tuple", *kids, *self.arguments(")"))
        if x.text == "[":
            self.i += 1
            if self.eat("]"):
                return node("Array")
            first = self.expr()
            if self.eat(";"):
                size = self.expr()
                self.need("]")
                return node("Repeat", first, size)
            if self.eat("]"):
                return node("Array", first)
            self.need(",")
            return node("Array", first, *self.arguments("]"))
        if x.text == "{":
            return self.block()[0]
        if x.text == "|":
            return self.closure()
        if x.text == "<" or self.at("::"):
            return self.path_expr(True)
        self.fail("an expression")

    def word_true(self, no_struct):
        self.i += 1
        return leaf("Literal", "Bool")

    word_false = word_true

    def word_if(self, no_struct):
        self.i += 1
        condition = self.expr(True)
        then, other = self.block()[0], None
        if self.eat("else"):
            other = self.word_if(False) if self.at("if") else self.block()[0]
        return node("If", condition, then, opt(other))

    def word_let(self, no_struct):
        self.i += 1
        pattern = self.pattern()
        self.need("=")
        return node("LetExpr", pattern, self.binary(_LEVEL["&&"] + 1, True))

    def word_match(self, no_struct):
        self.i += 1
        kids = [self.expr(True)]
        self.need("{")
        while not self.eat("}"):
            self.attributes()
            pattern = self.pattern()
            guard = self.expr() if self.eat("if") else None
            self.need("=>")
            closed = self.at("{")
            body = self.expr_statement(True) if closed else self.expr()
            kids.append(node("MatchArm", pattern, opt(guard), body))
            if not self.eat(",") and not self.at("}") and not (self.t[self.i - 1].kind == "p" and self.t[self.i - 1].text == "}"):
                self.fail("','")
        return node("Match", *kids)

    def word_loop(self, no_struct):
        self.i += 1
        return node("Loop", self.block()[0])

    def word_while(self, no_struct):
        self.i += 1
        return node("While", self.expr(True), self.block()[0])

    def word_for(self, no_struct):
        if self.at("<", 1):
            return None
        self.i += 1
        pattern = self.pattern()
        self.need("in")
        return node("ForLoop", pattern, self.expr(True), self.block()[0])

    def word_unsafe(self, no_struct):
        self.i += 1
        return self.block()[0]

    def word_const(self, no_struct):
        self.i += 1
        return self.block()[0] if self.at("{") else self.closure()

    def word_async(self, no_struct):
        self.i += 1
        if self.at("|") or self.at("move") and self.at("|", 1):
            return self.closure()
        self.eat("move")
        self.block()
        return leaf("Opaque")

    def word_move(self, no_struct):
        return self.closure()

    def word_static(self, no_struct):
        self.i += 1
        return self.closure()

    def word_return(self, no_struct):
        self.i += 1
        return node("Return", *([] if self._range_ends(no_struct) else [self.expr(no_struct)]))

    def word_break(self, no_struct):
        self.i += 1
        if self.now.kind == "life":
            self.i += 1
        return node("Break", *([] if self._range_ends(no_struct) else [self.expr(no_struct)]))

    def word_continue(self, no_struct):
        self.i += 1
        if self.now.kind == "life":
            self.i += 1
        return leaf("Continue")

    def closure(self) -> Node:
        slot = self._slot()
        self.eat("move")
        line, params = self.now.line, []
        if not self.eat("||"):
            self.need("|")
            while not self.eat("|"):
                self.attributes()
                pattern = self.pattern(alternatives=False)
                if self.eat(":"):
                    self.type()
                params.append(pattern)
                if not self.at("|"):
                    self.need(",")
        if self.eat("->"):
            self.type()
        body = self.expr()
        last = self.t[self.i - 1].last
        tree = node("Closure", body, *params)
        self._fill(slot, lambda: self._closure_unit(line, last, tree), self.test)
        return tree

    def _closure_unit(self, line: int, last: int, tree: Node) -> Unit:
        return Unit("closure", f"closure at {self.path}:{line}", line, last, leaf("Opaque"), Numbering().resolve(_copied(tree)), body_only=True)

    def _segment_leaf(self, name: str) -> Node:
        return name_leaf("Type" if name[:1].isupper() else "Variable", name)

    def path_expr(self, no_struct: bool) -> Node:
        names, qualified = self.path_names(turbofish=True)
        if self.at("!") and not self.at("!=") and self.t[self.i + 1].kind == "p" and self.t[self.i + 1].text in "([{":
            self.i += 1
            return self.macro(names[-1])
        if self.at("{") and not no_struct and not qualified | self._not_a_literal(names):
            return self.struct_literal()
        if len(names) == 1:
            return self._segment_leaf(names[0])
        return node("Path", *map(self._segment_leaf, names))

    def _not_a_literal(self, names: list[str]) -> bool:
        return names == ["self"] or names[-1] in ("super", "crate")

    def path_names(self, turbofish: bool) -> tuple[list[str], bool]:
        names: list[str] = []
        qualified = self.at("<")
        if qualified:
            self.i += 1
            self.type()
            if self.eat("as"):
                names, _ = self.path_names(turbofish=False)
            self.need(">")
            self.need("::")
        else:
            self.eat("::")
        while True:
            names.append(self.word())
            if not turbofish:
                if self.at("<") and not self.at("<=") and not self.at("<-"):
                    self.angles()
                elif self.at("(") and names[-1].startswith("Fn"):
                    self.balanced()
                    if self.eat("->"):
                        self.type(bounds=False)
            if not self.at("::"):
                return names, qualified
            self.i += 2
            if self.at("<"):
                self.angles()
                if not self.at("::"):
                    return names, qualified
                self.i += 2

    def struct_literal(self) -> Node:
        self.need("{")
        rest, fields = None, []
        while not self.eat("}"):
            self.attributes()
            if self.eat(".."):
                rest = None if self.at("}") else self.expr()
                continue
            name = self.now.text.partition(":")[2] if self.now.kind == "lit" else self.now.text
            self.i += 1
            value = self.expr() if self.eat(":") else self._segment_leaf(name)
            fields.append(node("FieldValue", name_leaf("Variable", name), value))
            if not self.at("}"):
                self.need(",")
        return node("StructInit", opt(rest), *fields)

    def macro(self, name: str) -> Node:
        a, b = self.balanced()
        inner = self.t[a:b]
        if not inner:
            return node("MacroCall", data=name)
        try:
            sub = _Parser([*inner, Token("end", "", inner[-1].last, inner[-1].last)], self.path)
            kids = []
            while sub.now.kind != "end":
                kids.append(sub.expr())
                if sub.now.kind != "end":
                    sub.need(",")
        except (RustSyntaxError, IndexError):
            kids = [leaf("Opaque")]
        return node("MacroCall", *kids, data=name)

    # -- types

    def type(self, bounds: bool = True) -> Node:
        x = self.now
        if x.kind == "p":
            return self._punctuated_type(x, bounds)
        if x.kind == "life":
            self.i += 1
            return leaf("Opaque")
        if x.kind == "lit":
            self.i += 1
            return leaf("Opaque")
        if self.eat("_"):
            return leaf("TypeInfer")
        if self.eat("impl"):
            return node("TypeImplTrait", *self.bound_list(bounds))
        if x.text == "dyn" and not self.at("::", 1):
            self.i += 1
            self.bound_list(bounds)
            return leaf("Opaque")
        if x.text in ("fn", "unsafe", "extern", "for"):
            while not self.at("("):
                if self.now.kind == "end":
                    self.fail("'('")
                self.angles() if self.at("<") else self._one()
            self.balanced()
            if self.eat("->"):
                self.type(bounds=False)
            return leaf("Opaque")
        names, qualified = self.path_names(turbofish=False)
        if self.at("!") and self.t[self.i + 1].kind == "p" and self.t[self.i + 1].text in "([{":
            self.i += 1
            return self.macro(names[-1])
        if bounds and self.at("+") and not self.at("+="):
            self.i += 1
            self.bound_list(True)
            return leaf("Opaque")
        leaves = [name_leaf("Type", n, "TypePlaceholder") for n in names]
        return leaves[0] if len(leaves) == 1 and not qualified else node("TypePath", *leaves)

    def _punctuated_type(self, x: Token, bounds: bool) -> Node:
        if x.text == "&":
            self.i += 1
            if self.now.kind == "life":
                self.i += 1
            mutable = self.eat("mut")
            return node("TypeReference", self.type(bounds=False), data="mut" if mutable else "")
        if x.text == "*":
            self.i += 2
            self.type(bounds=False)
            return leaf("Opaque")
        if x.text == "!":
            self.i += 1
            return leaf("TypeNever")
        if x.text == "[":
            self.i += 1
            item = self.type()
            if self.eat(";"):
                size = self.expr()
                self.need("]")
                return node("TypeArray", item, size)
            self.need("]")
            return node("TypeSlice", item)
        if x.text == "(":
            self.i += 1
            if self.eat(")"):
                return leaf("TypeUnit")
            kids = [self.type()]
            if self.eat(")"):
                return kids[0]
            while not self.eat(")"):
                self.need(",")
                if not self.at(")"):
                    kids.append(self.type())
            return node("TypeTuple", *kids)
        if x.text == "<" or self.at("::"):
            names, qualified = self.path_names(turbofish=False)
            leaves = [name_leaf("Type", n, "TypePlaceholder") for n in names]
            return leaves[0] if len(leaves) == 1 and not qualified else node("TypePath", *leaves)
        self.fail("a type")

    def bound_list(self, more: bool) -> list[Node]:
        out = []
        while True:
            if self.now.kind == "life":
                self.i += 1
            else:
                wrapped = self.eat("(")
                self.eat("?") or self.eat("~")
                self.eat("const")
                if self.at("for"):
                    self.i += 1
                    self.angles()
                if self.at("use") and self.at("<", 1):
                    self.i += 1
                    self.angles()
                else:
                    names, _ = self.path_names(turbofish=False)
                    leaves = [name_leaf("Type", n, "TypePlaceholder") for n in names]
                    out.append(leaves[0] if len(leaves) == 1 else node("TypePath", *leaves))
                if wrapped:
                    self.need(")")
            if not (more and self.at("+") and not self.at("+=")):
                return out
            self.i += 1

    # -- patterns

    def pattern(self, alternatives: bool = True) -> Node:
        leading = alternatives and self.eat("|")
        first = self.single_pattern()
        if not alternatives or not (self.at("|") and not self.at("||")):
            return node("PatOr", first) if leading else first
        kids = [first]
        while self.at("|") and not self.at("||"):
            self.i += 1
            kids.append(self.single_pattern())
        return node("PatOr", *kids)

    def _bound(self) -> Node | None:
        """An end of a range pattern: a literal, signed or not, or a path."""
        sign = self.eat("-")
        if self.now.kind == "lit":
            out = leaf("Literal", self.now.text.partition(":")[0])
            self.i += 1
            return node("UnaryOp", out, data="Neg") if sign else out
        if self.now.kind == "id" and self.now.text not in ("if",) or self.at("<") or self.at("::"):
            return self.path_expr(True)
        return None

    def _range_pattern(self, left: Node | None) -> Node:
        self.i += 2
        self.eat("=")
        return node("PatRange", opt(left), opt(self._bound()))

    def single_pattern(self) -> Node:
        self.attributes()
        x = self.now
        if x.kind == "lit" or x.kind == "p" and x.text == "-":
            value = self._bound()
            if self.at(".."):
                return self._range_pattern(value)
            return node("PatLiteral", value if value.disc == "Literal" else value.kids[0])
        if x.kind == "p":
            return self._punctuated_pattern(x)
        if x.text in ("true", "false"):
            self.i += 1
            return node("PatLiteral", leaf("Literal", "Bool"))
        if self.eat("_"):
            return leaf("PatWild")
        if x.text == "const" and self.at("{", 1):
            self.i += 1
            self.balanced()
            return leaf("Opaque")
        if x.kind != "id":
            self.fail("a pattern")
        by_ref = self.at("ref") and self.t[self.i + 1].kind == "id"
        self.i += by_ref
        by_mut = self.eat("mut")
        simple = self.now.kind == "id" and not (self.at("::", 1) or self.at("(", 1) or self.at("{", 1) or self.at("..", 1) or self.at("!", 1) and self.t[self.i + 2].text in "([{" or self.at("<", 1))
        if by_ref or by_mut or simple and self.now.text not in ("self", "Self", "crate", "super"):
            name = self.word()
            if self.eat("@"):
                self.single_pattern()
            return name_leaf("Variable", name, "PatPlaceholder")
        return self._path_pattern()

    def _path_pattern(self) -> Node:
        names, _ = self.path_names(turbofish=True)
        if self.at("!"):
            self.i += 1
            return self.macro(names[-1])
        if self.eat("("):
            return node("PatStruct", *self._patterns(")"))
        if self.eat("{"):
            return node("PatStruct", *self._field_patterns())
        if self.at(".."):
            left = self._segment_leaf(names[0]) if len(names) == 1 else node("Path", *map(self._segment_leaf, names))
            return self._range_pattern(left)
        leaves = [name_leaf("Variable", n, "PatPlaceholder") for n in names]
        return leaves[0] if len(leaves) == 1 else node("PatStruct", *leaves)

    def _patterns(self, close: str) -> list[Node]:
        out = []
        while not self.eat(close):
            out.append(self.pattern())
            if not self.at(close):
                self.need(",")
        return out

    def _field_patterns(self) -> list[Node]:
        out = []
        while not self.eat("}"):
            self.attributes()
            if self.eat(".."):
                continue
            by_ref, by_mut = self.eat("ref"), self.eat("mut")
            name = self.now.text.partition(":")[2] if self.now.kind == "lit" else self.now.text
            self.i += 1
            value = self.pattern() if not (by_ref or by_mut) and self.eat(":") else name_leaf("Variable", name, "PatPlaceholder")
            out.append(node("FieldValue", name_leaf("Variable", name, "PatPlaceholder"), value, order=(1, 0)))
            if not self.at("}"):
                self.need(",")
        return out

    def _punctuated_pattern(self, x: Token) -> Node:
        if self.at(".."):
            after = self.t[self.i + 2]
            if self.at("..=") or after.kind == "lit" or after.kind == "p" and after.text == "-":
                return self._range_pattern(None)
            self.i += 2
            return leaf("PatRest")
        if x.text == "&":
            self.i += 1
            mutable = self.eat("mut")
            return node("PatReference", self.single_pattern(), data="mut" if mutable else "")
        if x.text == "(":
            self.i += 1
            if self.eat(")"):
                return node("PatTuple")
            first = self.pattern()
            if self.eat(")"):
                return node("PatTuple", first) if first.disc == "PatRest" else leaf("Opaque")
            self.need(",")
            return node("PatTuple", first, *self._patterns(")"))
        if x.text == "[":
            self.i += 1
            return node("PatSlice", *self._patterns("]"))
        if x.text == "<" or self.at("::"):
            return self._path_pattern()
        self.fail("a pattern")


def _copied(x: Node) -> Node:
    """Trees of closures are numbered by themselves and again within the function around them."""
    return Node(x.disc, x.data, [_copied(k) for k in x.kids], x.ident, x.order)


def rust_units(path: str, text: str) -> list[Unit]:
    """Units in order of position; RustSyntaxError if the file does not parse."""
    units: list[Unit | None] = []
    parser = _Parser(tokenize(text), path, units)
    try:
        parser.items()
    except IndexError:
        raise RustSyntaxError("unexpected end of file") from None
    return [u for u in units if u is not None]
