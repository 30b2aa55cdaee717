"""Every link inside the components of the n-gram Jaccard join.

Both ends of a link lie in one component, so all pairs of a component are judged, in cells of bounded size: a group of m
near copies costs m*m/2 pairs, as many as it can have links, but rows only in proportion to m times its number of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cells import judged_in_cells
from ..scratch import Scratch

_COUNTS = pa.schema([("rep", pa.int64()), ("n_links", pa.int64())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("shared", pa.int64())])


def _judge(percent: int, pairs: bool):
    def judge(a: dict, b: dict, shared: np.ndarray, alone: bool) -> pa.Table:
        linked = shared * (100 + percent) >= percent * (a["n"][:, None] + b["n"][None, :])
        if alone:
            np.fill_diagonal(linked, False)
        if pairs:
            i, j = np.nonzero(np.triu(linked) if alone else linked)
            one, two = a["rep"][i], b["rep"][j]
            return pa.table([np.minimum(one, two), np.maximum(one, two), shared[i, j]], schema=_LINKS)
        linked = linked.astype(np.float64)  # sums of counts are exact far beyond any number of documents
        rep, counts = a["rep"], (linked @ b["members"]).astype(np.int64)
        if not alone:
            rep, counts = np.concatenate([rep, b["rep"]]), np.concatenate([counts, (a["members"] @ linked).astype(np.int64)])
        return pa.table([rep[counts > 0], counts[counts > 0]], schema=_COUNTS)

    return judge


def links(index: DataFrame, parts: DataFrame, classes: DataFrame, percent: int, scratch: Scratch, pairs: bool) -> DataFrame:
    """All links of ``index`` (rep, n, grams), whose ends are in one component of ``parts`` (node, component).

    With ``pairs`` (u, v, shared), one row for each.  Else (rep, n_links), to be summed by rep: the ids that a set's links
    lead to, where ``classes`` (class_id, members) says how many a set stands for.
    """
    sets = index.join(parts.withColumnRenamed("node", "rep"), "rep").join(classes.select(F.col("class_id").alias("rep"), "members"), "rep")
    sets = sets.withColumnRenamed("grams", "keys")
    schema = "u long, v long, shared long" if pairs else "rep long, n_links long"
    return judged_in_cells(sets, ["component"], ["rep", "n", "members"], "n", 100 / percent, _judge(percent, pairs), schema, scratch)
