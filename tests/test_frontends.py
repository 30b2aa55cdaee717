"""Both languages: extraction, lines, test marks, and what is equal to what."""

from __future__ import annotations

import pytest

from kindred.frontend import braces
from kindred.frontend.captures import parse_queries
from kindred.frontend.mapping import BLOCK, DROPPED, Cst, Defines, Grammar, Infix, Leaf, Name, Prefix, Shape, cst_units
from kindred.frontend.python_source import python_units
from kindred.frontend.registry import LANGUAGES, file_rows
from kindred.frontend.rust_source import RustSyntaxError, rust_units
from kindred.frontend.tree import Numbering, canonical, count, sub_units


def py(text):
    return python_units("m.py", text)


def rs(text):
    return rust_units("m.rs", text)


def same(parse, a, b):
    return parse(a)[0].fingerprint() == parse(b)[0].fingerprint()


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("def f(x):\n    return x + 1", "def g(y):\n    return y + 2"),
        ("def f(x):\n    return (x)", "def f(x):\n    return x"),
        ("@d\ndef f(x):\n    return x", "def f(x):\n    return x"),
        ("async def f(x):\n    return x", "def f(x):\n    return x"),
        ("def f(x):\n    # note\n    return x", "def f(x):\n    return x"),
        ("def f(x):\n    x: int = 1", "def f(x):\n    x = 1"),
        ("def f(a):\n    return f'{a}'", "def f(a):\n    return 'a'"),
    ],
)
def test_python_equal(a, b):
    assert same(py, a, b)


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("break", "continue"), ("x = None", "x = True"), ("x += 1", "x -= 1"), ("x = (1, 2)", "x = [1, 2]"), ("x = {1, 2}", "x = [1, 2]"), ("x = a // b", "x = a / b"), ("x = a ** b", "x = a * b"),
        ("x = a < b < c", "x = a < b"), ("x = a.b", "x = a[b]"), ("x = 1", "x = 1.0"), ("x = not a", "x = -a"), ("x = a in b", "x = a not in b"), ("x = 1, 2", "x = (1, 2)"), ("yield a", "await a"), ("return a", "return"),
    ],
)
def test_python_different(a, b):
    wrap = "async def f(a, b, c):\n    while a:\n        {}\n".format
    assert not same(py, wrap(a), wrap(b))


def test_python_units_and_kinds():
    units = py("class A:\n    def f(self): pass\n    def g(self): return lambda x: x\n\ndef outer():\n    def inner(): pass\n")
    assert [(u.kind, u.name) for u in units] == [("class", "A"), ("function", "f"), ("function", "g"), ("closure", "anonymous at m.py:3"), ("function", "outer"), ("function", "inner")]
    assert [(u.line_start, u.line_end) for u in units][-2:] == [(5, 6), (6, 6)]
    assert [u.is_test for u in py("def test_a(): pass\nclass TestB:\n    def c(self): pass")] == [True, True, False]


def test_python_signatures():
    assert [count(u.signature) for u in py("def a(): pass\ndef b(x): pass\ndef c(x, y=1, *z, k): pass\nf = lambda: 1\nclass D: pass")] == [1, 1, 7, 0, 0]


def test_python_chained_comparison_folds_right_with_the_first_operator():
    assert "BinaryOp:Lt:2|Placeholder:Variable#0:0|BinaryOp:Lt:2" in canonical(py("def f(a, b, c):\n    a < b > c")[0].body)


def test_python_elif_keeps_the_first_alternative():
    a = "def f(x):\n    if x:\n        a()\n    elif y:\n        b()\n    else:\n        c()\n"
    assert canonical(py(a)[0].body) == canonical(py(a.replace("    else:\n        c()\n", ""))[0].body)


@pytest.mark.parametrize(("text", "disc"), [("(a, b)", "Tuple"), ("a, b", "Block"), ("(a), (b)", "Block"), ("(a, ')')", "Tuple"), ("(\n a, # )\n b,\n)", "Tuple"), ("()", "Tuple"), ("(a)", "Placeholder"), ("((a, b))", "Tuple")])
def test_python_tuples(text, disc):
    assert py(f"def f(a, b):\n    return {text}")[0].body.kids[0].kids[0].disc == disc


def test_python_match_arms_are_sub_units():
    u = py("def f(x):\n    match x:\n        case 1:\n            return g(x)\n        case _ if x:\n            return h(x)\n")[0]
    assert [d for _, d, _ in sub_units(u.body, 1)] == ["match arm 1", "match arm 2"]


def test_python_syntax_errors_keep_valid_blocks():
    assert [u.name for u in py("def a():\n    return 1\n\ndef b(:\n    return\n\ndef c():\n    return 2\n")] == ["a", "c"]
    assert py("\x00") == [] and py("") == []


SUM = "fn f(xs: Vec<i32>) -> i32 { let mut s = 0; for x in xs.iter() { if *x > 0 { s += *x; } } s }"


def test_rust_counts_nodes_of_signature_and_body():
    (u,) = rs(SUM)
    assert (u.kind, u.name, count(u.signature), count(u.body), u.node_count) == ("function", "f", 5, 22, 27)


def test_rust_renaming_changes_nothing_and_structure_does():
    assert same(rs, SUM, SUM.replace("xs", "input").replace("s = 0", "s = 7").replace("Vec<i32>", "Vec<u8>"))
    assert not same(rs, SUM, SUM.replace("*x > 0", "*x < 0"))


def test_rust_units():
    units = rs("""
#[cfg(test)]
mod tests { #[test] fn t() {} fn helper() { let c = |x| x + 1; } }
struct S<T>(T);
impl<T: Clone> S<T> { pub fn new(t: T) -> Self { let f = |x| x; S(t) } }
impl<T> Iterator for S<T> { type Item = T; fn next(&mut self) -> Option<T> { None } }
impl fmt::Display for &S<u8> { fn fmt(&self) {} }
trait Shape { const N: usize = 3; fn area(&self) -> f64; fn twice(&self) -> f64 { let g = || 2.0; g() * self.area() } }
fn outer() { fn inner() {} }
""")
    assert [(u.kind, u.name, u.is_test) for u in units] == [
        ("function", "t", True), ("function", "helper", True), ("closure", "closure at m.rs:3", True), ("method", "S::new", False), ("trait impl block", "<S as Iterator>::next", False),
        ("trait impl block", "<Unknown as fmt::Display>::fmt", False), ("closure", "closure at m.rs:8", False), ("function", "outer", False), ("function", "inner", False),
    ]
    assert not rs("#[cfg(all(test, x))] mod m { fn f() {} }")[0].is_test


def shape(text):
    return canonical(rs("fn f() { " + text + " }")[0].body).split("|", 1)[1]


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("a.b(c);", "Semi::1|MethodCall::3|Placeholder:Variable#0:0|Placeholder:Function#0:0|Placeholder:Variable#1:0"),
        ("a.b", "FieldAccess::2|Placeholder:Variable#1:0|Placeholder:Variable#0:0"),
        ("x.0.1", "FieldAccess::2|FieldAccess::2|Placeholder:Variable#2:0|Placeholder:Variable#1:0|Placeholder:Variable#0:0"),
        ("(a)", "Paren::1|Placeholder:Variable#0:0"),
        ("a..=b", "Range::2|Placeholder:Variable#0:0|Placeholder:Variable#1:0"),
        ("..", "Range::2|None::0|None::0"),
        ("A { b: 1, ..c }", "StructInit::2|Placeholder:Variable#0:0|FieldValue::2|Placeholder:Variable#1:0|Literal:Int:0"),
        ("if let Some(x) = y { 1 } else { 2 }", "If::3|LetExpr::2|PatStruct::1|PatPlaceholder:Variable#0:0|Placeholder:Variable#1:0|Block::1|Literal:Int:0|Block::1|Literal:Int:0"),
        ("match x { 1 | 2 => a, P { q, .. } if z => b, _ => c }", "Match::4|Placeholder:Variable#0:0|MatchArm::3|PatOr::2|PatLiteral::1|Literal:Int:0|PatLiteral::1|Literal:Int:0|None::0|Placeholder:Variable#1:0|MatchArm::3|PatStruct::1|FieldValue::2|PatPlaceholder:Variable#2:0|PatPlaceholder:Variable#2:0|Placeholder:Variable#3:0|Placeholder:Variable#4:0|MatchArm::3|PatWild::0|None::0|Placeholder:Variable#5:0"),
        ("println!(\"{}\", x)", "MacroCall:println:2|Literal:Str:0|Placeholder:Variable#0:0"),
        ("vec![0; 3]", "MacroCall:vec:1|Opaque::0"),
        ("a as u8 + b", "BinaryOp:Add:2|Cast::2|Placeholder:Variable#0:0|TypePlaceholder:Type#0:0|Placeholder:Variable#1:0"),
        ("a + b * c == d && e", "BinaryOp:And:2|BinaryOp:Eq:2|BinaryOp:Add:2|Placeholder:Variable#0:0|BinaryOp:Mul:2|Placeholder:Variable#1:0|Placeholder:Variable#2:0|Placeholder:Variable#3:0|Placeholder:Variable#4:0"),
        ("let Some(x) = y else { return; };", "LetBinding::4|PatStruct::1|PatPlaceholder:Variable#0:0|None::0|Placeholder:Variable#1:0|Block::1|Semi::1|Return::0"),
        ("|a, b| a", "Closure::3|Placeholder:Variable#0:0|PatPlaceholder:Variable#0:0|PatPlaceholder:Variable#1:0"),
        ("Vec::<u8>::new()", "Call::1|Path::2|Placeholder:Type#0:0|Placeholder:Variable#0:0"),
        ("b'a'; 'a'; b\"a\"; c\"a\"; r#\"a\"#; 1.5; 1e3; 2f32; true", "Semi::1|Literal:Byte:0|Semi::1|Literal:Char:0|Semi::1|Literal:ByteStr:0|Semi::1|Literal:CStr:0|Semi::1|Literal:Str:0|Semi::1|Literal:Float:0|Semi::1|Literal:Float:0|Semi::1|Literal:Float:0|Literal:Bool:0"),
        ("async { 1 }", "Opaque::0"),
        ("unsafe { x }", "Block::1|Placeholder:Variable#0:0"),
        ("'a: loop { break 'a 1 }", "Loop::1|Block::1|Break::1|Literal:Int:0"),
        ("x?.await", "Await::1|Try::1|Placeholder:Variable#0:0"),
        ("&mut x; &*y", "Semi::1|Reference:mut:1|Placeholder:Variable#0:0|Reference::1|UnaryOp:Deref:1|Placeholder:Variable#1:0"),
        ("[0u8; 4]; [a, b]; ()", "Semi::1|Repeat::2|Literal:Int:0|Literal:Int:0|Semi::1|Array::2|Placeholder:Variable#0:0|Placeholder:Variable#1:0|Tuple::0"),
        (";", "Semi::1|Opaque::0"),
        ("struct X; use a::b;", "Opaque::0|Opaque::0"),
    ],
)
def test_rust_shapes(text, form):
    assert shape(text) == form


def test_rust_types():
    u = rs("fn f<'a, T: Into<U>>(a: &'a mut [T], b: (A, B), c: impl Fn(A) -> B + 'a, d: [u8; 4], e: Box<dyn X>, g: p::Q<R>, h: !, i: ()) -> Option<T> where T: X {}")[0]
    assert canonical(u.signature) == (
        "FnSignature::9|TypePlaceholder:Type#0:0|FieldValue::2|PatPlaceholder:Variable#0:0|TypeReference:mut:1|TypeSlice::1|TypePlaceholder:Type#1:0|FieldValue::2|PatPlaceholder:Variable#1:0|TypeTuple::2|TypePlaceholder:Type#2:0|TypePlaceholder:Type#3:0"
        "|FieldValue::2|PatPlaceholder:Variable#2:0|TypeImplTrait::1|TypePlaceholder:Type#4:0|FieldValue::2|PatPlaceholder:Variable#3:0|TypeArray::2|TypePlaceholder:Type#5:0|Literal:Int:0|FieldValue::2|PatPlaceholder:Variable#4:0|TypePlaceholder:Type#6:0"
        "|FieldValue::2|PatPlaceholder:Variable#5:0|TypePath::2|TypePlaceholder:Type#7:0|TypePlaceholder:Type#8:0|FieldValue::2|PatPlaceholder:Variable#6:0|TypeNever::0|FieldValue::2|PatPlaceholder:Variable#7:0|TypeUnit::0"
    )


@pytest.mark.parametrize("text", ["fn f( {", "fn f() { let x = ; }", "fn f() { \"open }", "}", "fn f() { a b }"])
def test_rust_errors_fail_the_file(text):
    with pytest.raises(RustSyntaxError):
        rs(text)


def test_mapped_grammar():
    ident = lambda s: Cst("id", s)
    op = Cst("+", "+", named=False)
    add = Cst("sum", children=[ident("a"), op, ident("b"), Cst("comment"), ident("a")])
    g = Grammar({"id": Name(), "int": Leaf("Literal", "Int"), "sum": Infix({"+": "Add"}), "minus": Prefix({"-": "Neg"}), "comment": DROPPED, ("call", "new"): Shape("Call", ("function", "arguments/*")), "ret": Shape("Return"), "block": BLOCK, "list": Shape("Array"), "match": Shape("Match", ("subject", "*arm")), "arm": Shape("MatchArm", ("pattern", "guard", "consequence")), "fn": Defines()})
    shape = lambda x: canonical(Numbering().resolve(g.normalize(x)))
    assert shape(add) == "BinaryOp:Add:2|Placeholder:Variable#0:0|BinaryOp:Add:2|Placeholder:Variable#1:0|Placeholder:Variable#0:0"
    assert shape(Cst("sum", children=[ident("a")])) == "BinaryOp:Other:2|Placeholder:Variable#0:0|None::0"
    assert shape(Cst("sum", children=[Cst("?", "?", named=False)], fields={"left": ident("a"), "right": Cst("int")})) == "BinaryOp:Other:2|Placeholder:Variable#0:0|Literal:Int:0"
    assert shape(Cst("minus", children=[Cst("-", "-", named=False), ident("x")])) == "UnaryOp:Neg:1|Placeholder:Variable#0:0" and shape(Cst("minus")) == "UnaryOp:Other:1|None::0"
    assert shape(Cst("paren", children=[ident("x")])) == "Placeholder:Variable#0:0" and shape(Cst("comment")) == "Opaque::0"
    assert shape(Cst("pass")) == "Opaque::0" and shape(Cst("two", children=[Cst("int"), Cst("int")])) == "Block::2|Literal:Int:0|Literal:Int:0"
    assert shape(Cst("ERROR", children=[ident("x")])) == "Opaque::0"
    assert shape(Cst("new", fields={"function": ident("f"), "arguments": Cst("args", children=[Cst("int")])})) == "Call::2|Placeholder:Variable#0:0|Literal:Int:0"
    assert shape(Cst("call", fields={"function": ident("f")})) == "Call::1|Placeholder:Variable#0:0"
    assert shape(Cst("match", children=[Cst("int"), Cst("arm", fields={"pattern": Cst("int"), "consequence": Cst("block")})], fields={"subject": ident("x")})) == "Match::2|Placeholder:Variable#0:0|MatchArm::3|Literal:Int:0|None::0|Block::0"
    fn = Cst("fn", children=[], fields={"name": ident("go"), "parameters": Cst("args", children=[ident("a")]), "body": Cst("block", children=[add])}, line_end=3)
    root = Cst("file", children=[fn, Cst("fn", fields={"name": ident("declared")})])
    (u,) = cst_units(root, "x", g)
    assert (u.name, u.line_end, u.node_count) == ("go", 3, 7)
    (v,) = cst_units(root, "x", g, parse_queries("(fn parameters: (_ (id)) @parameters other: (id)? body: (block) @body) @method ; all"))
    assert (v.kind, v.name, v.fingerprint()) == ("method", "anonymous at x:1", u.fingerprint())


@pytest.mark.parametrize("text", ["fn", "(fn", "(fn name:)", "()", "(fn) %"])
def test_queries_that_are_none(text):
    with pytest.raises(ValueError):
        parse_queries(text)


def test_tolerant_parser():
    names = lambda text: [(u.kind, u.name) for u in braces.ANALYZER.parse("a.bs", text)]
    assert names("function a() { x = 1; } function b( { y; } function c() { let z = ; f(function (p) { return p; }); }") == [("function", "a"), ("function", "c"), ("closure", "anonymous at a.bs:1")]
    assert [(u.kind, u.name) for u in cst_units(braces.parse("function a() { g(() => 1); }"), "a.bs", braces.GRAMMAR)] == [("function", "a"), ("closure", "anonymous at a.bs:1")]
    for broken in ("", "}}}", "{{{ ( [", "function", "if (", "(" * 5000, "x = 'open", "/* open", "a..b; function ok() { return; }"):
        assert braces.parse(broken).kind == "program"
    assert names("a..b; function ok() { return; }") == [("function", "ok")]


@pytest.mark.parametrize(("analyzer", "text"), [("rust", "fn f() -> i32 {{ {0}1{1} }}"), ("rust", "fn f() {{ {2}{3} }}"), ("braces", "function f() {{ return {0}1{1}; }}")])
def test_deeply_nested_sources(analyzer, text):
    deep = 5000
    text = text.format("(" * deep, ")" * deep, "if a { " * deep, "}" * deep)
    (row,) = file_rows(LANGUAGES.get(analyzer, braces.ANALYZER), 0, "a", text, 1, 0, None)
    assert (row["section"], row["name"]) == ("unit", "f")
