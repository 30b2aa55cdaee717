"""Source files: listing, exclusion, language detection and reading.

Spark's own file index hides names that begin with ``_`` or ``.``, ``__init__.py`` among them, so files are listed by a
walk and opened inside tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AmbiguousLanguage, NoRecognizedFiles
from ..frontend.registry import LANGUAGES
from ..schema import SOURCE_FILES
from ..shipping import ship


def extension(file: Column) -> Column:
    """Lower-cased extension of a path; empty if it has none."""
    return F.lower(F.regexp_extract(file, r"[^/.][^/]*\.([^./]+)$", 1))


def has_extension(file: Column, extensions: Sequence[str]) -> Column:
    return extension(file).isin([e.lower() for e in extensions])


def is_excluded(file: Column, patterns: Sequence[str]) -> Column:
    """Any pattern is a substring of the whole path."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.contains(file, F.lit(p))
    return out


def walk(root: str | Path) -> Iterator[str]:
    """All files below root, without directories called ``target`` or, below the root, hidden ones."""
    root = Path(root)
    if root.is_file():
        yield str(root)
        return
    if root.name == "target":
        return
    for folder, below, names in os.walk(root):
        below[:] = sorted(d for d in below if d != "target" and not d.startswith("."))
        yield from (os.path.join(folder, n) for n in sorted(names))


def _suffix(path: str) -> str:
    return Path(path).suffix[1:].lower()


def scan_files(root: str | Path, exclude: Sequence[str] = (), extensions: Iterable[str] = ("rs",)) -> list[str]:
    wanted = {e.lower() for e in extensions}
    return [f for f in walk(root) if _suffix(f) in wanted and not any(p in f for p in exclude)]


def detect_language(root: str | Path) -> str:
    """The one language whose files lie below root; excludes do not count."""
    return language_of(walk(root))


def language_of(files: Iterable[str]) -> str:
    """The one language that the files are in, by their extensions; others do not matter."""
    seen = {_suffix(f) for f in files}
    found = [name for name, a in LANGUAGES.items() if seen & set(a.extensions)]
    if not found:
        raise NoRecognizedFiles
    if len(found) > 1:
        raise AmbiguousLanguage(found)
    return found[0]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        content, errors = [], []
        for file in batch["file"]:
            try:
                with open(file, encoding="utf-8", newline="") as f:
                    content.append(f.read())
                errors.append(None)
            except (OSError, UnicodeDecodeError) as e:
                content.append(None)
                errors.append(f"Failed to read {file}: {e}")
        yield batch.assign(content=content, read_error=errors)


def read_sources(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """SOURCE_FILES, numbered in the order given; a file that cannot be read has an error and no content."""
    ship(spark)
    rows = spark.createDataFrame(list(enumerate(files)), "file_no long, file string")
    tasks = max(1, min(len(files), spark.sparkContext.defaultParallelism * 4))
    return rows.repartition(tasks).mapInPandas(_read, SOURCE_FILES)
