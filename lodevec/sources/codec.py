"""Embeddings as bytes, base 64 or JSON, for single values and for columns.

Binary version 2: ``u8 version = 2, u8 flags, u32 count, u32 dimensions``, if flag 1 is set ``u32 length`` and
JSON metadata, then little-endian floats. Version 1, which is still read: ``u32 count``, and for each vector
``u32 dimensions`` and its floats.
"""

from __future__ import annotations

import base64
import json
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodevec.errors import DimensionMismatchError, ValidationError
from lodevec.functions import flat

FORMATS = ("json", "binary", "base64")


def serialize(vectors, how: str = "binary", metadata: dict | None = None) -> bytes | str:
    """JSON leaves the metadata out."""
    rows = [np.asarray(v, "<f4") for v in vectors]
    if how == "json":
        return json.dumps([v.astype(float).tolist() for v in rows])
    if how not in FORMATS:
        raise ValidationError(f"unknown format {how!r}")
    sizes = {len(v) for v in rows}
    if len(sizes) > 1:
        raise DimensionMismatchError("vectors differ in length")
    text = json.dumps(metadata).encode() if metadata is not None else None
    head = struct.pack("<BBII", 2, int(text is not None), len(rows), sizes.pop() if sizes else 0)
    data = head + (struct.pack("<I", len(text)) + text if text is not None else b"") + b"".join(v.tobytes() for v in rows)
    return data if how == "binary" else base64.b64encode(data).decode()


def deserialize(data: bytes | str, how: str = "binary") -> tuple[list[np.ndarray], dict | None]:
    """(vectors, metadata)."""
    if how == "json":
        return [np.array(v, np.float32) for v in json.loads(data)], None
    if how not in FORMATS:
        raise ValidationError(f"unknown format {how!r}")
    raw = base64.b64decode(data) if how == "base64" else bytes(data)
    try:
        if raw[:1] == b"\x02":
            _, flags, count, dim = struct.unpack_from("<BBII", raw)
            at, meta = 10, None
            if flags & 1:
                size = struct.unpack_from("<I", raw, at)[0]
                meta = json.loads(raw[at + 4 : at + 4 + size])
                at += 4 + size
            flat = np.frombuffer(raw, "<f4", count * dim, at).astype(np.float32).reshape(count, dim)
            return list(flat), meta
        count, at, out = struct.unpack_from("<I", raw)[0], 4, []
        for _ in range(count):
            dim = struct.unpack_from("<I", raw, at)[0]
            out.append(np.frombuffer(raw, "<f4", dim, at + 4).astype(np.float32))
            at += 4 + 4 * dim
        return out, None
    except (struct.error, ValueError) as e:
        raise ValidationError("the bytes aren't serialised vectors") from e


def _check(how: str) -> None:
    if how not in FORMATS:
        raise ValidationError(f"unknown format {how!r}")


def serialize_column(vectors: Column | str, how: str = "binary") -> Column:
    """``serialize`` of a column of arrays of vectors: binary version 2, or text for JSON and base 64; null stays null."""
    _check(how)

    @F.arrow_udf("binary" if how == "binary" else "string")
    def pack(v: pa.Array) -> pa.Array:
        inner = v.flatten()
        values, sizes, _ = flat.flattened(inner)
        values = values.astype("<f4")
        counts = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
        rows, first = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
        out: list = []
        for there, n, at in zip(v.is_valid().to_pylist(), counts.tolist(), rows.tolist()):
            own = [values[first[i] : first[i] + sizes[i]] for i in range(at, at + n)]
            out.append(serialize(own, how) if there else None)
        return pa.array(out, pa.binary() if how == "binary" else pa.string())

    return pack(F.col(vectors) if isinstance(vectors, str) else vectors)


def deserialize_column(blobs: Column | str, how: str = "binary") -> Column:
    """The vectors of a column that ``serialize_column`` made, or of binary values of version 1."""
    _check(how)

    @F.arrow_udf("array<array<float>>")
    def unpack(b: pa.Array) -> pa.Array:
        found = [None if x is None else deserialize(x, how)[0] for x in b.to_pylist()]
        vectors = [v for x in found if x is not None for v in x]
        inner = flat.lists(np.concatenate([np.zeros(0, np.float32), *vectors]), np.array([len(v) for v in vectors], np.int64), np.ones(len(vectors), bool))
        counts, valid = np.array([0 if x is None else len(x) for x in found], np.int64), np.array([x is not None for x in found], bool)
        at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), inner, mask=pa.array(~valid)) if not valid.all() else pa.ListArray.from_arrays(pa.array(at), inner)

    return unpack(F.col(blobs) if isinstance(blobs, str) else blobs)
