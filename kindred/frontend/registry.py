"""Languages by name.  An analyzer turns a path and a text into units; further ones can be registered."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .. import schema
from .python_source import python_units
from .rust_source import RustSyntaxError, rust_units
from .tree import Unit, admitted, count, fingerprint, rows, sub_units


@dataclass(frozen=True)
class Analyzer:
    """parse(path, text) -> units; is_test(unit) says which are left out with ``exclude_tests``."""

    name: str
    extensions: tuple[str, ...]
    parse: Callable[[str, str], list[Unit]]
    is_test: Callable[[Unit], bool] = field(default=lambda unit: unit.is_test)


LANGUAGES: dict[str, Analyzer] = {
    "python": Analyzer("python", ("py", "pyi"), python_units),
    "rust": Analyzer("rust", ("rs",), rust_units),
}

ID_BITS = 32  # of a unit's place in its file, below the number of the file
FRAMES = 400_000  # Python's own calls take no C stack, so nesting is bounded by memory alone


@contextmanager
def deep_recursion():
    """Lets parsers follow nested sources far beyond Python's default limit."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, FRAMES))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


_UNIT = schema.names(schema.UNITS)
EXTRACTED = f"section string, warning string, {schema.UNITS}"


def parse_file(analyzer: Analyzer, path: str) -> list[Unit]:
    with open(path, encoding="utf-8", newline="") as f, deep_recursion():
        return analyzer.parse(path, f.read())


def parse_files(analyzer: Analyzer, paths: list[str]) -> tuple[list[Unit], list[str]]:
    units, warnings = [], []
    for path in paths:
        try:
            units += parse_file(analyzer, path)
        except (OSError, ValueError) as e:
            warnings.append(f"Failed to parse {path}: {e}")
    return units, warnings


def _row(section: str, unit_id: int, u: Unit, path: str, tree, print_: str, n: int, kind: str, name: str, parent: str | None, is_test: bool) -> dict:
    keys = [r["path_key"] for r in rows(tree) if r["disc"] != "None"]
    return {"section": section, "warning": None, "unit_id": unit_id, "kind": kind, "name": name, "file": path, "line_start": u.line_start, "line_end": u.line_end, "fingerprint": print_, "node_count": n, "body_count": len(keys), "body_keys": keys, "parent_name": parent, "is_test": is_test}


def file_rows(analyzer: Analyzer, file_no: int, path: str, text: str, min_nodes: int, min_lines: int, min_sub_nodes: int | None) -> Iterator[dict]:
    """Rows of EXTRACTED: units, then (if asked for) their sub-units, or one warning.  Ids ascend with file and position;
    a text is one value of less than 2**31 bytes, so ID_BITS have room for all that it can hold."""
    try:
        with deep_recursion():
            units = admitted(analyzer.parse(path, text), min_nodes, min_lines)
    except (RustSyntaxError, RecursionError, ValueError) as e:
        yield dict.fromkeys(["section", *_UNIT]) | {"section": "warning", "warning": f"Failed to parse {path}: {e}"}
        return
    base = file_no << ID_BITS
    n_sub = 0
    for i, u in enumerate(units):
        yield _row("unit", base + i, u, path, u.body, u.fingerprint(), u.node_count, u.kind, u.name, None, analyzer.is_test(u))
        for kind, description, tree in sub_units(u.body, min_sub_nodes) if min_sub_nodes is not None else ():
            yield _row("sub", base + n_sub, u, path, tree, fingerprint(tree), count(tree), kind, description, u.name, analyzer.is_test(u))
            n_sub += 1


def extract(sources: DataFrame, analyzer: Analyzer, min_nodes: int = 10, min_lines: int = 0, min_sub_nodes: int | None = None) -> DataFrame:
    """EXTRACTED rows of readable sources.  A file is parsed in one task; a narrow stage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [r for n, p, t in zip(batch["file_no"], batch["file"], batch["content"], strict=True) for r in file_rows(analyzer, int(n), p, t, min_nodes, min_lines, min_sub_nodes)]
            out = pd.DataFrame(found, columns=["section", "warning", *_UNIT])
            for c in ("unit_id", "line_start", "line_end", "node_count", "body_count"):
                out[c] = out[c].astype("Int64")
            yield out

    return sources.where(F.col("content").isNotNull()).select("file_no", "file", "content").mapInPandas(run, EXTRACTED)


def register_udtfs(spark: SparkSession) -> None:
    """SQL table functions ``<language>_units(path, content)``, one row for each unit of any size."""
    for name, analyzer in LANGUAGES.items():

        class Units:
            def eval(self, path: str, content: str, _analyzer=analyzer):
                if content is not None:
                    for r in file_rows(_analyzer, 0, path or "", content, 0, 0, None):
                        if r["section"] == "unit":
                            yield tuple(r[c] for c in _UNIT)

        spark.udtf.register(f"{name}_units", udtf(Units, returnType=schema.UNITS))
