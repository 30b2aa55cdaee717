"""Sets of 64-bit keys as bytes: sorted, as differences, their bytes by rank, compressed.

Keys that lie close together, as those of a tree in preorder do, take a byte or two each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<cqq")  # type, number of values, compressed bytes


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def _squeezed(values: np.ndarray, codec: pa.Codec) -> bytes:
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    body = codec.compress(planes, asbytes=True) if planes else b""
    return _HEAD.pack(values.dtype.char.encode(), len(values), len(body)) + body


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as one value."""
    codec = _codec()
    return b"".join(_squeezed(x, codec) for x in arrays)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    codec, out, at = _codec(), [], 0
    while at < len(data):
        kind, n, size = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        dtype = np.dtype(kind.decode())
        planes = codec.decompress(data[at : at + size], decompressed_size=n * dtype.itemsize, asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n))
        at += size
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers, none of them negative, in the least type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def differences(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys; they wrap around, so any keys have them."""
    return np.diff(keys, prepend=np.zeros(1, np.int64))


def pack_sets(lists: pa.ListArray) -> pa.Array:
    """Each list as bytes."""
    codec = _codec()
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return pa.array([_squeezed(differences(np.sort(values[a:b])), codec) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())


def unpack_sets(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All keys, one list after the other, and the number of keys of each."""
    sets = [np.cumsum(unpack_arrays(x)[0]) for x in packed.to_pylist()]
    return np.concatenate(sets) if sets else np.zeros(0, np.int64), np.array([len(x) for x in sets], np.int64)


def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a list of keys, as bytes; null stands for no keys."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        if lists.null_count:
            lists = pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pack_sets(lists)], names=[*batch.schema.names[:-1], "packed_keys"])


def unpacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way back."""
    for batch in batches:
        keys, sizes = unpack_sets(batch.column(batch.num_columns - 1))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys, pa.int64()))], names=[*batch.schema.names[:-1], "body_keys"])
