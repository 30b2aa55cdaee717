"""Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTES = 1 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` has at most ``limit`` bytes in each piece, or one row; empty ones are left out."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
