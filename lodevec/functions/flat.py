"""Arrow lists and binaries as flat numpy arrays and back, for kernels without a loop over rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flattened(v: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values one after another, length of each row, whether it's there); a null has the length 0."""
    sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return v.flatten().to_numpy(zero_copy_only=False), sizes, v.is_valid().to_numpy(zero_copy_only=False)


def bytes_of(b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``flattened`` for binaries."""
    sizes = pc.fill_null(pc.binary_length(b), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(b)], pa.int32()), pc.fill_null(b, b"")), b"") if len(b) else None
    data = np.frombuffer(joined[0].as_buffer(), np.uint8) if joined is not None else np.zeros(0, np.uint8)
    return data, sizes, b.is_valid().to_numpy(zero_copy_only=False)


def _layout(sizes: np.ndarray, valid: np.ndarray) -> tuple[pa.Buffer | None, pa.Buffer]:
    bitmap = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return bitmap, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32).tobytes())


def lists(values: np.ndarray, sizes: np.ndarray, valid: np.ndarray) -> pa.Array:
    own = pa.array(values)
    bitmap, at = _layout(sizes, valid)
    return pa.Array.from_buffers(pa.list_(own.type), len(sizes), [bitmap, at], children=[own])


def binaries(data: np.ndarray, sizes: np.ndarray, valid: np.ndarray) -> pa.Array:
    bitmap, at = _layout(sizes, valid)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [bitmap, at, pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def places(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions ``first[i]`` to ``first[i] + sizes[i]`` of all rows."""
    stop = np.cumsum(sizes)
    return np.repeat(first - (stop - sizes), sizes) + np.arange(int(stop[-1]) if len(stop) else 0)
