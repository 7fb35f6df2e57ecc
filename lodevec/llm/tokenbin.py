"""Token ids as fixed-width bit-packed binary with block offsets.

Every id takes the least number of bits that holds the vocabulary (15 for 32,000 pieces). A document's
ids are cut into blocks of ``BLOCK`` ids, each of which begins at a whole byte, so that any block can be
read by itself and unpacked by numpy without looking at the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm.pieces import MODEL
from lodevec.llm.wordcache import encoder
from lodevec.runtime import read_table

#: Ids of a block; a multiple of 8, so that full blocks end at whole bytes at any width.
BLOCK = 1024
SCHEMA = "n_tokens bigint, bits int, block_len int, block_offsets array<int>, packed binary"


def width(vocab: int) -> int:
    """The least bits that hold ids 0..vocab-1."""
    return max(1, int(vocab - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a big-endian bit string, filled with zeros to a whole byte."""
    ids = np.asarray(ids)
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >> bits):
        raise ValueError("an id doesn't fit the width")
    planes = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(planes.ravel()).tobytes()


def unpack_ids(packed: bytes, n: int, bits: int) -> np.ndarray:
    """The n ids of ``pack_ids``."""
    flat = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * bits).reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, 32 - bits :] = flat
    return np.packbits(full, axis=1).view(">u4").ravel().astype(np.int32)


def offsets_of(n: int, bits: int, block: int = BLOCK) -> np.ndarray:
    """The byte at which each block begins, and the end."""
    return np.append(np.arange(-(-n // block)) * (block * bits // 8), -(-n * bits // 8)).astype(np.int32)


def read_block(packed: bytes, block_offsets, number: int, n: int, bits: int, block: int = BLOCK) -> np.ndarray:
    """The ids of one block, reading no other byte."""
    ids = min(block, n - number * block)
    return unpack_ids(packed[block_offsets[number] : block_offsets[number + 1]], ids, bits)


def _packed(ids: np.ndarray, counts: np.ndarray, bits: int) -> pa.Array:
    """``pack_ids`` of each text of a run at once: texts are padded to 8 ids, so each begins at a byte."""
    room = -(-counts // 8) * 8
    at = np.cumsum(room) - room
    padded = np.zeros(int(room.sum()), ids.dtype)
    padded[np.repeat(at - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = ids
    flat, first, size = np.frombuffer(pack_ids(padded, bits), np.uint8), at * bits // 8, -(-counts * bits // 8)
    stop = np.cumsum(size)
    data = flat[np.repeat(first - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], stop]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _offsets(counts: np.ndarray, bits: int, block: int) -> pa.Array:
    """``offsets_of`` each text of a run."""
    blocks = -(-counts // block)
    stop = np.cumsum(blocks + 1)
    number = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - blocks - 1, blocks + 1)
    flat = number * (block * bits // 8)
    flat[stop - 1] = -(-counts * bits // 8)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]).astype(np.int32)), pa.array(flat.astype(np.int32)))


def tokenise(docs: DataFrame, model: str = MODEL, block: int = BLOCK, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: doc_id, n_tokens, bits, block_len, block_offsets, packed.

    The ids are exactly the library's for the whole text, however long. A null or empty text has 0 tokens, the offsets
    [0] and no byte. Repeated rows give repeated rows, null keys stay null, an empty table gives an empty
    result, and other columns are neither read nor returned. A narrow step: nothing is shuffled.
    """
    if block < 8 or block % 8:
        raise ValueError("block must be a positive multiple of 8")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def work(batches):
        enc = encoder(model)
        bits = width(enc.vocab)
        for b in batches:
            for i, j, ids, n in enc(b.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n), pa.array(np.full(j - i, bits, np.int32)), pa.array(np.full(j - i, block, np.int32)), _offsets(n, bits, block), _packed(ids, n, bits)],
                    names=["doc_id", "n_tokens", "bits", "block_len", "block_offsets", "packed"],
                )

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def token_ids(packed: DataFrame) -> DataFrame:
    """(doc_id, ids) of rows that ``tokenise`` made; null where a row has no bytes at all."""

    @F.arrow_udf("array<int>")
    def unpack(data: pa.Array, n: pa.Array, bits: pa.Array) -> pa.Array:
        return pa.array([None if d is None else unpack_ids(d, k, w) for d, k, w in zip(data.to_pylist(), n.to_pylist(), bits.to_pylist())], pa.list_(pa.int32()))

    return packed.select("doc_id", unpack("packed", "n_tokens", "bits").alias("ids"))


def op2_token_binary(spark, sf_dir: str) -> DataFrame:
    return tokenise(read_table(spark, sf_dir, "documents"))
