"""Files, configuration, ignore file and commands, end to end on sources written here."""

from __future__ import annotations

import io
import json

import pytest

from kindred.cli import run
from kindred.config import Config, apply_overrides, load_config
from kindred.errors import AmbiguousLanguage, BadIgnoreFile, NoRecognizedFiles
from kindred.frontend.registry import LANGUAGES, register_udtfs
from kindred.operators.ignore import add_entry, load_entries, remove_entry, save_entries
from kindred.report import relative
from kindred.sources.files import detect_language, read_sources, scan_files

LOOP = """pub fn {name}({arg}: Vec<i32>) -> i32 {{
    let mut acc = 0;
    for item in {arg}.iter() {{
        if *item {test} {{
            acc += *item;
        }}
    }}
    acc
}}
"""
BRANCHES = """pub fn {name}(x: i32) -> i32 {{
    if x > {limit} {{
        let doubled = x * 2;
        let shifted = doubled + 1;
        shifted
    }} else {{
        {other}
    }}
}}
"""


def loop(name, arg="xs", test="> 0"):
    return LOOP.format(name=name, arg=arg, test=test)


@pytest.fixture
def project(tmp_path):
    def make(**files):
        for name, text in files.items():
            path = tmp_path / name.replace("__", "/").replace("_dot_", ".")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text, encoding="utf-8")
        return tmp_path

    return make


def command(spark, root, *args):
    out, err = io.StringIO(), io.StringIO()
    code = run([*args, "--path", str(root)], spark, out, err)
    return code, out.getvalue(), err.getvalue()


def test_scan(project):
    root = project(src__main_dot_rs="", src__lib_dot_RS="", src__utils__helper_dot_rs="", target__debug__build_dot_rs="", src__target__x_dot_rs="", _dot_hidden__secret_dot_rs="", src__readme_dot_md="", src___dot_own_dot_rs="")
    names = lambda **kw: sorted(f.rsplit("/", 1)[1] for f in scan_files(root, **kw))
    assert names() == [".own.rs", "helper.rs", "lib.RS", "main.rs"]
    assert names(exclude=["utils"]) == [".own.rs", "lib.RS", "main.rs"]
    assert scan_files(root / "target") == [] and scan_files(root / "nothing") == []


def test_detect_language(project, tmp_path):
    with pytest.raises(NoRecognizedFiles):
        detect_language(tmp_path)
    root = project(a_dot_py="", b_dot_txt="")
    assert detect_language(root) == "python"
    project(c_dot_rs="")
    with pytest.raises(AmbiguousLanguage, match="python, rust"):
        detect_language(root)


def test_config_layers(project):
    root = project(Cargo_dot_toml="[package.metadata.dupes]\nmin_nodes = 15\nexclude = ['a']\nunknown = 1", dupes_dot_toml="min_nodes = 25\nsub_function = true")
    c = load_config(root)
    assert (c.min_nodes, c.exclude, c.sub_function, c.similarity_threshold) == (25, ("a",), True, 0.9)
    c = apply_overrides(c, min_nodes=3, exclude=["b"], sub_function=False, similarity_threshold=None)
    assert (c.min_nodes, c.exclude, c.sub_function) == (3, ("a", "b"), True)
    project(dupes_dot_toml="min_nodes = [")
    assert load_config(root).min_nodes == 15
    assert load_config(root / "none") == Config(root=root / "none")


def test_ignore_file(tmp_path):
    assert load_entries(tmp_path) == []
    entries = add_entry(add_entry([], "a" * 16, 'say "no"\n\\'), "b" * 16)
    assert add_entry(entries, "a" * 16, "other") == entries
    entries[1]["members"] = ["x", "é"]
    save_entries(tmp_path, entries)
    assert load_entries(tmp_path) == entries
    left, removed = remove_entry(entries, "a" * 16)
    assert removed and len(left) == 1 and not remove_entry(left, "c" * 16)[1]
    (tmp_path / ".dupes-ignore.toml").write_text("[[ignore")
    with pytest.raises(BadIgnoreFile):
        load_entries(tmp_path)


def test_relative():
    assert relative("/p/src/a.rs", "/p") == relative("/p/src/a.rs", "/p/") == "src/a.rs"
    assert relative("/pq/a.rs", "/p") == "/pq/a.rs" and relative("a", None) == "a"


def test_exact_report(spark, project):
    root = project(src__lib_dot_rs=loop("one") + "\n" + loop("two", "values") + "\n" + loop("three", "vs"))
    code, out, _ = command(spark, root, "report")
    assert code == 0
    assert "Total code units analyzed: 3" in out and "Exact duplicates: 1 groups (3 code units)" in out and "Duplication: 100.0% exact, 0.0% near (of 27 total lines)" in out
    assert "Exact Duplicates\n================\n\nGroup 1 (fingerprint: " in out and "3 members):\n  - one (function) at src/lib.rs:1-9\n  - two (function) at src/lib.rs:11-19" in out
    assert "Near Duplicates" not in out
    code, out, _ = command(spark, root, "check", "--max-exact", "0")
    assert code == 1 and "Check FAILED: 1 exact duplicate groups (max: 0)" in out
    code, out, _ = command(spark, root, "check", "--max-exact", "1", "--max-exact-percent", "100")
    assert code == 0 and out.endswith("\nCheck passed.\n")
    code, out, _ = command(spark, root, "check", "--max-exact-percent", "5.5")
    assert code == 1 and "Check FAILED: 100.0% exact duplicate lines (max: 5.5%)" in out


def test_near_report_and_json(spark, project):
    root = project(lib_dot_rs=loop("a", test="> 0") + loop("b", test="< 0") + loop("c", test="% 2 == 0"))
    _, out, _ = command(spark, root, "report", "--threshold", "0.7")
    assert "No exact duplicates found." in out and "similarity: 83%, 3 members):" in out
    _, out, _ = command(spark, root, "report")
    assert "similarity: 95%, 2 members):" in out
    _, out, _ = command(spark, root, "report", "--format", "json")
    head, exact, near = out.strip().split("\n\n")[0], *[json.loads(x) for x in out.strip().split("\n\n")[1].replace("]\n[", "]\x00[").split("\x00")]
    assert json.loads(head)["near_duplicate_units"] == 2 and "sub_exact_groups" not in json.loads(head)
    assert exact == [] and near[0]["similarity"] == 42 / 44 and set(near[0]["members"][0]) == {"name", "kind", "file", "line_start", "line_end"}


def test_sub_functions(spark, project):
    root = project(lib_dot_rs=BRANCHES.format(name="f", limit=1, other="x") + BRANCHES.format(name="g", limit="x * x * x", other="{ g(x, x, x); x - 1 }"))
    _, out, _ = command(spark, root, "report", "--sub-function")
    assert "Sub-function exact: 1 groups (2 units)" in out and "Sub-function Exact Duplicates" in out and "if-then branch (if branch) in f at lib.rs:1-9" in out
    _, out, _ = command(spark, root, "report")
    assert "Sub-function" not in out
    _, out, _ = command(spark, root, "stats", "--sub-function", "--min-sub-nodes", "1000")
    assert "Sub-function" not in out


def test_excluding_tests(spark, project):
    root = project(lib_dot_rs=loop("a") + loop("b") + "#[cfg(test)]\nmod tests {\n" + loop("c") + "}\n")
    assert "Exact duplicates: 1 groups (3 code units)" in command(spark, root, "stats")[1]
    assert "Exact duplicates: 1 groups (2 code units)" in command(spark, root, "stats", "--exclude-tests")[1]


def test_python_project(spark, project):
    root = project(pkg__b_dot_py="def g(a):\n    b = a + 2\n    return b * b\n", bad_dot_py="def h(:\n")
    (root / "pkg" / "__init__.py").write_text("def f(x):\n    y = x + 1\n    return y * y\n")
    code, out, err = command(spark, root, "report", "--min-nodes", "1")
    assert code == 0 and "Exact duplicates: 1 groups (2 code units)" in out and "pkg/__init__.py:1-3" in out and err == ""


def test_bad_files_are_warnings(spark, project):
    root = project(good_dot_rs=loop("a"), bad_dot_rs="fn f( {")
    (root / "bytes.rs").write_bytes(b"\xff\xfe fn")
    code, out, err = command(spark, root, "stats")
    assert code == 0 and "Total code units analyzed: 1" in out
    assert "Warning: Failed to read" in err and "Warning: Failed to parse" in err


def test_empty_scans_are_errors(spark, tmp_path):
    code, _, err = command(spark, tmp_path, "stats", "--language", "rust")
    assert code == 2 and "No source files found in" in err
    assert command(spark, tmp_path, "stats")[0] == 2


def test_ignore_workflow(spark, project):
    root = project(lib_dot_rs=loop("a") + loop("b"))
    fingerprint = command(spark, root, "report")[1].split("fingerprint: ")[1][:16]
    assert command(spark, root, "ignored")[1] == "No ignored fingerprints.\n"
    assert command(spark, root, "ignore", "xyz")[0] == 2
    assert command(spark, root, "ignore", fingerprint.upper(), "--reason", "known")[1] == f"Added {fingerprint} to ignore list.\n"
    command(spark, root, "ignore", "deadbeefdeadbeef")
    assert f"  {fingerprint} (reason: known)\n" in command(spark, root, "ignored")[1]
    assert "No exact duplicates found." in command(spark, root, "report")[1]
    _, out, _ = command(spark, root, "cleanup", "--dry-run")
    assert "deadbeefdeadbeef" in out and "1 stale entries would be removed." in out and len(load_entries(root)) == 2
    assert "Removed 1 stale entries." in command(spark, root, "cleanup")[1]
    assert [e["fingerprint"] for e in load_entries(root)] == [fingerprint]
    assert "No stale entries found." in command(spark, root, "cleanup")[1]


def test_reading_and_table_functions(spark, project):
    root = project(a_dot_py="def f(x):\n    return lambda: x\n")
    rows = read_sources(spark, [str(root / "a.py"), str(root / "missing.py")]).orderBy("file_no").collect()
    assert rows[0].read_error is None and rows[1].content is None and rows[1].read_error.startswith("Failed to read")
    register_udtfs(spark)
    got = spark.sql("SELECT name, kind FROM python_units('a.py', 'def f(x):\n    return lambda: x\n')").collect()
    assert [tuple(r) for r in got] == [("f", "function"), ("anonymous at a.py:2", "closure")]
    assert set(LANGUAGES) == {"python", "rust"}
