"""Small source files, as rows of schema.SOURCE_FILES: the driver's tables hold no source code."""

from __future__ import annotations

PYTHON = {
    "loops.py": '''def total(xs):
    out = 0
    for x in xs:
        if x > 0:
            out += x
    return out


async def amount(values):
    result: int = 0
    for v in values:
        if v > 9:
            result += v
    return result
''',
    "shapes.py": '''class Box(Base):
    """A box."""

    @property
    def size(self, *rest, scale=1.5, **options):
        while not self.empty and scale < 2 <= 3:
            del self.items[0]
            break
        else:
            pass
        return (self.a, f"{scale}", b"x", None, True)

    def walk(self):
        with open(self.path) as f, lock:
            yield from (line.strip() for line in f if line)
        try:
            import os.path as p
        except (OSError, ValueError) as e:
            raise RuntimeError("bad") from e
        finally:
            assert self.done, "left"
''',
    "choices.py": '''def pick(x):
    match x:
        case [a, b] if a:
            return {a: b}
        case {"k": 1}:
            return {x, -x}
        case _:
            return [y for y in x if y][1:2]


key = lambda r, n=1: r.k if r else n ** 2
''',
    "test_parts.py": '''def test_one():
    value = lambda: 1
    a, *b = call(1, k=2, *[3])
    if (n := len(b)) in a:
        a = b @ n
    elif a is not b:
        global z
    assert a


def broken(:
''',
}
RUST = {
    "loops.rs": """fn total(xs: &[i32]) -> i32 {
    let mut out = 0;
    for x in xs { if *x > 0 { out += *x; } }
    out
}

pub fn amount(values: &[u8]) -> u8 {
    let mut result = 9;
    for v in values { if *v > 1 { result += *v; } }
    result
}
""",
    "items.rs": """impl Shape {
    pub async fn area(&self, k: Option<f64>) -> f64 { self.sides.iter().map(|s| s.width * s.height).sum() }
    fn tuple(self) -> (A, B) { (self.0, [1u8; 4]) }
}
impl<T: Clone> Draw for Shape { fn draw(&mut self) { println!("{}", self); } }
trait Named { const N: usize = 1; fn name(&self) -> String; fn shout(&self) -> String { let up = || self.name(); up() } }
""",
    "choices.rs": """fn pick(x: Option<i32>, y: &mut Vec<u8>) -> Result<i32, E> {
    let Some(n) = x else { return Err(E::Missing) };
    let r = match n {
        0 => "zero",
        1 | 2 if n > 1 => r#"few"#,
        3..=9 => { y.push(b'a'); "many" }
        _ => unreachable!(),
    };
    while let Some(b) = y.pop() { if b == 0 { continue; } }
    let v = 'a: loop { break 'a -n };
    Ok(v as i32 + helper(&r, S { a: 1.5, ..d })?)
}
""",
    "tests.rs": """#[cfg(test)]
mod tests {
    #[test]
    fn one() { assert!(1 == 1); }
    fn two() { if true { a(); b(); } else { c(); d(); } }
}
""",
    "broken.rs": "fn broken( {",
}
BRACES = {
    "script.bs": """function total(xs, limit) {
  let sum = 0;
  for (x of xs) { if (x > limit) { sum += x; } else sum = -x; }
  while (sum > 100 && !done) { sum = sum / 2; break; }
  return sum;
}
function broken(a { return a; }
function testAfter(a) { let x = ; return [1, "s", a.b[0], (p, q) => p + q * 2, null]; }
""",
}

IGNORED = "5acfdad846eead47"  # the loops of SIMILAR that are equal
SIMILAR = {
    "/project/src/loops.rs": RUST["loops.rs"],
    "/project/src/less.rs": """fn least(ys: &[i32]) -> i32 {
    let mut acc = 0;
    for y in ys { if *y < 0 { acc += *y; } }
    acc
}

fn count(ys: &[i32]) -> i32 {
    let mut acc = 0;
    for y in ys { if *y <= 9 { acc += *y; } }
    acc
}
""",
    "/project/src/branches.rs": """impl Gate {
    fn open(&self, n: i32) -> i32 {
        if n > 3 { let a = n * 2; let b = a + 1; log(a, b); b } else { 0 }
    }
}

fn close(m: i32, k: i32) -> i32 {
    let z = k;
    while z > m { step(z); }
    if k < m { let c = m * 2; let d = c + 1; log(c, d); d } else { z }
}

#[cfg(test)]
mod tests {
    fn total(xs: &[i32]) -> i32 {
        let mut out = 0;
        for x in xs { if *x > 0 { out += *x; } }
        out
    }
}
""",
}
