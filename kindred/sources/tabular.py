"""Front-ends for tables: rows of ordinary tables as trees.

A text is a block of line blocks whose leaves are its blank-separated tokens: digits are integer literals, anything
else a variable, numbered by first use.  A group of rows is a block with one leaf for each row.  A text lies in one
row, so it is numbered, hashed and cut into nodes there, in Arrow batches, and nothing of it is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..functions.fingerprints import fingerprint
from ..functions.keysets import pack_sets
from ..operators.ranks import with_rank
from ..scratch import Scratch
from ..shipping import ship

ROOT, LINE, LITERAL = -3, -2, -1  # codes of nodes that are no variables; those are coded by their number
_U = np.uint64
_BITS = 21  # of a key for each of line, place and code


def _codes(tokens: list[str], numbers: dict[str, int]) -> list[int]:
    """Each token as a literal or as a variable, numbered by first use."""
    return [LITERAL if t.isdigit() and t.isascii() else numbers.setdefault(t, len(numbers)) for t in tokens]


def _lines(text: str | None) -> list[list[str]]:
    return [[t for t in line.split(" ") if t] for line in (text or "").split("\n")]


_variables: list[str] = []  # their tokens in the canonical form, made when first met


def _canonical(codes: list[int]) -> str:
    _variables.extend(f"|Placeholder:Variable#{c}:0" for c in range(len(_variables), max(codes, default=LITERAL) + 1))
    return "".join([_variables[c] if c >= 0 else "|Literal:Int:0" for c in codes])


def _path_keys(line: np.ndarray, nth: np.ndarray, code: np.ndarray) -> np.ndarray:
    """All ancestors are blocks, so the way down to a node is told by line and place.

    The three lie side by side in a key, so keys rise in preorder and pack well; a node whose numbers do not fit has a
    hash, below zero.
    """
    parts = [line.astype(np.int64) + 1, nth.astype(np.int64) + 1, code.astype(np.int64) - ROOT]
    keys = parts[0] << 2 * _BITS | parts[1] << _BITS | parts[2]
    wide = (parts[0] | parts[1] | parts[2]) >> _BITS != 0
    if wide.any():
        with np.errstate(over="ignore"):
            x = np.zeros(len(keys), _U)
            for part in parts:
                x = (x ^ part.view(_U)) * _U(0x9E3779B97F4A7C15)
                x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
                x ^= x >> _U(32)
        keys = np.where(wide, (x | _U(1 << 63)).view(np.int64), keys)
    return keys


def _laid_out(lines: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, place in it or -1 for its block, code) of the nodes of all lines, in preorder."""
    counts = np.array([len(x) + 1 for x in lines], np.int64)
    starts = np.cumsum(counts) - counts
    line = np.repeat(np.arange(len(lines)), counts)
    nth = np.arange(len(line)) - starts[line] - 1
    code = np.full(len(line), LINE, np.int64)
    code[nth >= 0] = np.fromiter(chain.from_iterable(lines), np.int64)
    return line, nth, code


def _lists(sizes: list[int] | np.ndarray, values: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _text_keys(texts: list[list[list[int]]]) -> pa.ListArray:
    """Path keys of whole texts, given as the codes of their lines: root, then line by line."""
    own = np.array([len(lines) for lines in texts], np.int64)
    line, nth, code = _laid_out(list(chain.from_iterable(texts)))
    first = np.repeat(np.cumsum(own) - own, own)  # of a line's text, the number of its first line
    below = np.bincount(np.repeat(np.arange(len(own)), own)[line], minlength=len(own))
    roots = np.cumsum(below) - below
    line, nth, code = (np.insert(x, roots, r) for x, r in ((line - first[line], -1), (nth, -1), (code, ROOT)))
    return _lists(below + 1, _path_keys(line, nth, code))


_NODES = pa.schema([("unit_id", pa.int64()), *[(c, pa.int32()) for c in ("pos", "line_no", "nth", "code", "n_children")]])


def _node_rows(whole: bool):
    """Nodes of whole texts, or of each line as a tree of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for unit, text in zip(batch.column("unit_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                numbers: dict[str, int] = {}
                lines = [_codes(tokens, numbers if whole else {}) for tokens in _lines(text)]
                line, nth, code = _laid_out(lines)
                kids = np.where(nth < 0, np.array([len(x) for x in lines])[line], 0)
                pos = np.arange(1, len(line) + 1)
                if whole:
                    line, nth, code, kids, pos = (np.concatenate([[x], y]) for x, y in ((-1, line), (-1, nth), (ROOT, code), (len(lines), kids), (0, pos)))
                yield pa.RecordBatch.from_arrays([pa.array([unit] * len(line), pa.int64()), *[pa.array(x, pa.int32()) for x in (pos, line, nth, code, kids)]], schema=_NODES)

    return run


def _described(nodes: DataFrame) -> DataFrame:
    root, block = F.col("code") == ROOT, F.col("code") <= LINE
    return nodes.withColumn("disc", F.when(block, "Block").when(F.col("code") == LITERAL, "Literal").otherwise("Placeholder")).withColumn(
        "data", F.when(block, "").when(F.col("code") == LITERAL, "Int").otherwise(F.concat(F.lit("Variable#"), F.col("code").cast("string")))
    ).withColumn("is_root", root)


def _exploded(texts: DataFrame, whole: bool) -> DataFrame:
    ship(texts.sparkSession)
    rows = _spread(texts.select(F.col("unit_id").cast("long"), F.col("text").cast("string")))
    return _described(rows.mapInArrow(_node_rows(whole), "unit_id long, pos int, line_no int, nth int, code int, n_children int"))


def text_nodes(texts: DataFrame) -> DataFrame:
    """Preorder nodes (unit_id, pos, parent, depth, line_no, child_idx, disc, data, n_children) of texts(unit_id, text)."""
    head = F.col("nth") < 0
    return _exploded(texts, True).select(
        "unit_id",
        "pos",
        F.when(F.col("is_root"), -1).when(head, 0).otherwise(F.col("pos") - F.col("nth") - 1).alias("parent"),
        F.when(F.col("is_root"), 0).when(head, 1).otherwise(2).alias("depth"),
        "line_no",
        F.when(F.col("is_root"), 0).when(head, F.col("line_no")).otherwise(F.col("nth")).alias("child_idx"),
        "disc",
        "data",
        "n_children",
    )


def line_nodes(texts: DataFrame) -> DataFrame:
    """Each line's block as a tree of its own: places count from the line, variables again from 0."""
    head = F.col("nth") < 0
    depth, place = F.when(head, 0).otherwise(1), F.when(head, 0).otherwise(F.col("nth"))
    return _exploded(texts, False).select("unit_id", F.col("line_no").alias("sub_line"), "pos", F.lit(0).alias("line_no"), depth.alias("depth"), place.alias("child_idx"), "disc", "data", "n_children")


def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:16]


def _held(keys: pa.ListArray | None, n: int, packed: bool) -> list[pa.Array]:
    """The columns body_keys and packed_keys: one has the keys, or none has."""
    lists, packs = pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary())
    if keys is None:
        return [lists, packs]
    return [lists, pack_sets(keys)] if packed else [keys, packs]


def _text_trees(with_keys: bool, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints, counts, held = [], [], []
            for text in batch.column("text").to_pylist():
                numbers: dict[str, int] = {}
                lines = [_codes(tokens, numbers) for tokens in _lines(text)]
                prints.append(_md5(f"None::0#Block::{len(lines)}" + "".join([f"|Block::{len(x)}{_canonical(x)}" for x in lines])))
                counts.append(1 + sum(len(x) + 1 for x in lines))
                if with_keys:
                    held.append(lines)
            columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            out = [pa.array(prints, pa.string()), pa.array(counts, pa.int32()), *_held(_text_keys(held) if with_keys else None, len(counts), packed)]
            yield pa.RecordBatch.from_arrays([*columns, *out], names=[*names, "fingerprint", "body_count", "body_keys", "packed_keys"])

    return run


_ABOUT = "unit_id long, kind string, name string, file string, line_start int, line_end int"


def _spread(docs: DataFrame) -> DataFrame:
    """Small tables may come in fewer pieces than there are cores; larger ones are taken as they lie."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _about(docs: DataFrame) -> DataFrame:
    docs = _spread(docs.select("doc_id", "text", "lang", "source"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("unit_id"), F.col("lang").cast("string").alias("kind"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"),
        F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("file"), F.lit(1).alias("line_start"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("int").alias("line_end"), text.alias("text"),
    )


def text_units(docs: DataFrame, labels: DataFrame | None = None, min_nodes: int = 0, min_lines: int = 0, with_keys: bool = True, packed: bool = False) -> DataFrame:
    """Units of documents(doc_id, text, lang, source); a toxic label marks a unit as test code.

    Without ``with_keys`` ``body_keys`` is null: fingerprints and statistics do not need it.  With ``packed`` it is null
    too, and one more column, ``packed_keys``, has the keys in a small part of the room.
    """
    ship(docs.sparkSession)
    units = _about(docs).mapInArrow(_text_trees(with_keys, packed), f"{_ABOUT}, fingerprint string, body_count int, body_keys array<long>, packed_keys binary")
    if labels is None:
        units = units.withColumn("is_test", F.lit(False))
    else:
        toxic = labels.groupBy(F.col("doc_id").alias("unit_id")).agg(F.max("toxic").alias("toxic"))
        units = units.join(toxic.hint("shuffle_hash"), "unit_id", "left").withColumn("is_test", F.coalesce(F.col("toxic") == 1, F.lit(False))).drop("toxic")
    out = units.select("unit_id", "kind", "name", "file", "line_start", "line_end", "fingerprint", F.col("body_count").alias("node_count"), "body_count", "body_keys", F.lit(None).cast("string").alias("parent_name"), "is_test", *["packed_keys"] * packed)
    return out.where((F.col("node_count") >= min_nodes) & (F.col("line_end") - F.col("line_start") + 1 >= min_lines))


def _line_trees(min_nodes: int, with_keys: bool, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found: list[tuple] = []
            held: list[list[int]] = []
            for doc, name, file, end, text in zip(*(batch.column(c).to_pylist() for c in ("unit_id", "name", "file", "line_end", "text")), strict=True):
                for i, tokens in enumerate(_lines(text)):
                    if len(tokens) + 1 < min_nodes:
                        continue
                    codes = _codes(tokens, {})
                    held.append(codes)
                    found.append((doc, i, file, end, _md5(f"Block::{len(codes)}{_canonical(codes)}"), len(codes) + 1, name))
            columns = list(zip(*found, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
            out = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            if with_keys:
                line, nth, code = _laid_out(held)
                keys = _lists([len(x) + 1 for x in held], _path_keys(np.zeros(len(line), np.int64), nth, code))
            else:
                keys = None
            yield pa.RecordBatch.from_arrays([*out, *_held(keys, len(held), packed)], names=["doc_id", "line", "file", "line_end", "fingerprint", "body_count", "parent_name", "body_keys", "packed_keys"])

    return run


def text_sub_units(docs: DataFrame, scratch: Scratch, min_sub_nodes: int = 5, with_keys: bool = True, packed: bool = False) -> DataFrame:
    """Units of the lines of documents, those of too few nodes left out; place and name are the parent's.

    Ids count the units in the order (document, line), so any number of lines has room.  Keys are as in text_units.
    """
    ship(docs.sparkSession)
    rows = _about(docs).select("unit_id", "name", "file", "line_end", "text")
    lines = rows.mapInArrow(_line_trees(min_sub_nodes, with_keys, packed), "doc_id long, line int, file string, line_end int, fingerprint string, body_count int, parent_name string, body_keys array<long>, packed_keys binary")
    return with_rank(lines, ["doc_id", "line"], "unit_id", scratch).select(
        "unit_id", F.lit("block").alias("kind"), F.concat(F.lit("line "), (F.col("line") + 1).cast("string")).alias("name"), "file",
        F.lit(1).alias("line_start"), "line_end", "fingerprint", F.col("body_count").alias("node_count"), "body_count", "body_keys", "parent_name", F.lit(False).alias("is_test"), *["packed_keys"] * packed,
    )


def _keys_of(items: Column) -> Column:
    return F.concat(F.array(F.xxhash64(F.lit("Block"))), F.transform(items, lambda x, i: F.xxhash64(i, x["data"])))


def order_units(lineitem: DataFrame) -> DataFrame:
    """Units of orders: a block with one item leaf for each line, by line number, return flag and status."""
    data = F.concat(F.coalesce("l_returnflag", F.lit("")), F.coalesce("l_linestatus", F.lit("")))
    items = lineitem.select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("n"), data.alias("data"))
    trees = items.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("n", "data"))).alias("items"))
    tokens = F.concat(F.array(F.concat(F.lit("Block::"), F.size("items").cast("string"))), F.transform("items", lambda x: F.concat(F.lit("Item:"), x["data"], F.lit(":0"))))
    count = (F.size("items") + 1).cast("int")
    return trees.select(
        "unit_id", F.lit("order").alias("kind"), F.concat(F.lit("order "), F.col("unit_id").cast("string")).alias("name"), F.lit("lineitem").alias("file"), F.lit(1).alias("line_start"), F.size("items").alias("line_end"),
        fingerprint(F.concat(F.lit("None::0#"), F.array_join(tokens, "|"))).alias("fingerprint"), count.alias("node_count"), count.alias("body_count"), _keys_of(F.col("items")).alias("body_keys"), F.lit(None).cast("string").alias("parent_name"), F.lit(False).alias("is_test"),
    )
