"""Words, lines and n-grams of whole Arrow text columns, hashed with numpy.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; words never cross rows.  Hashes depend on content alone
and are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK = 1 << 20  # bytes hashed at once: the working set is some 40 times that

_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


_GRAM = stream(64, 0x6A3) | _U(1)
_LENGTH = _U(0xD1B54A32D192ED03)
_STEP = _U(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # of eight bytes, the first k
LONG = 64  # bytes of the longest span that is hashed in lanes


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` has at most ``limit`` bytes in each piece, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(length, dtype=np.int64), 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row offsets in them; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def in_words(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    return ~_IS_SPACE[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    n = len(data)
    inside = in_words(data)
    opens = np.zeros(n + 1, bool)
    opens[offsets] = True
    before = np.empty(n, bool)
    before[:1], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1:], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | opens[:n]))
    ends = np.flatnonzero(inside & (~after | opens[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end] for each span; different seeds give independent hashes.

    Spans of up to LONG bytes are taken in, all at once, eight bytes at a time by a bijective mixer; longer ones go one
    by one through xxh3.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    n = ends - starts
    with np.errstate(over="ignore"):
        out = mix(mix(n.astype(np.uint64) * _LENGTH + _U(seed)) ^ (lanes[starts] & _KEEP[np.minimum(n, 8)]))
        at, done = np.flatnonzero((n > 8) & (n <= LONG)), 8
        while len(at):
            out[at] = mix((out[at] * _STEP) ^ (lanes[starts[at] + done] & _KEEP[np.minimum(n[at] - done, 8)]))
            done += 8
            at = at[n[at] > done]
    raw = memoryview(padded)
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]], seed)
    return out


def grams(hashes: np.ndarray, rows: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each run of k words within a row."""
    if len(hashes) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    n = len(hashes) - k + 1
    with np.errstate(over="ignore"):
        total = np.full(n, seed, np.uint64)
        for j in range(k):
            total += hashes[j : j + n] * _GRAM[j]
        at = np.flatnonzero(rows[:n] == rows[k - 1 :])
        return at, mix(total[at] + _U(k))


def whole_rows(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Hash of each row's whole word sequence (any length below the number of gram multipliers)."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        out = counts.astype(np.uint64) * _LENGTH
        np.add.at(out, rows, hashes * _GRAM[32 + np.arange(len(rows)) - first[rows]])
        return mix(out)


def lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.ListArray:
    """Rows of counts[i] values each."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
