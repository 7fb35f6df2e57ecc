"""Scalar, binary and half-precision quantisation of vectors as expressions, and calibrated codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.errors import ValidationError
from lodevec.functions import flat
from lodevec.functions.vector import _col, wide

INFO = {
    "fp16": {"bits": 16, "range": "about -65504 to 65504", "description": "half precision, held as floats"},
    "int8": {"bits": 8, "range": "-127 to 127", "description": "signed bytes of values within -1 to 1"},
    "uint8": {"bits": 8, "range": "0 to 255", "description": "unsigned bytes of values within 0 to 1"},
    "binary": {"bits": 1, "range": "0 or 1", "description": "one sign bit a dimension, first bit highest"},
}


def quantization_info(kind: str) -> dict:
    if kind not in INFO:
        raise ValidationError(f"unknown quantisation {kind!r}")
    return INFO[kind]


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def quantize_int8(v: Column | str) -> Column:
    """round(clamp(x, -1, 1) * 127), halves upwards; NaN becomes 0."""
    return F.transform(wide(v), lambda x: F.when(F.isnan(x), 0).otherwise(_half_up(_clamp(x, -1.0, 1.0) * 127)).cast("tinyint"))


def quantize_uint8(v: Column | str) -> Column:
    """round(clamp(x, 0, 1) * 255), halves upwards; NaN becomes 0."""
    return F.transform(wide(v), lambda x: F.when(F.isnan(x), 0).otherwise(_half_up(_clamp(x, 0.0, 1.0) * 255)).cast("smallint"))


def quantize_binary(v: Column | str) -> Column:
    """A bit for each dimension, 1 where it's above 0, in whole bytes with the first bit highest."""

    @F.arrow_udf("binary")
    def bits(rows: pa.Array) -> pa.Array:
        values, n, valid = flat.flattened(rows)
        room = -(-n // 8) * 8
        padded = np.zeros(int(room.sum()), bool)
        padded[flat.places(np.cumsum(room) - room, n)] = values > 0
        return flat.binaries(np.packbits(padded), room // 8, valid)

    return bits(_col(v))


def half(values: np.ndarray) -> np.ndarray:
    """Half precision by cutting the mantissa: small values become signed zeros, large ones infinite."""
    bits = np.ascontiguousarray(values, np.float32).view(np.uint32)
    sign, exponent = bits & np.uint32(0x80000000), ((bits >> np.uint32(23)) & np.uint32(0xFF)).astype(np.int32)
    out = bits & np.uint32(0xFFFFE000)
    out = np.where(exponent - 127 < -14, sign, out)
    out = np.where(exponent - 127 > 15, sign | np.uint32(0x7F800000), out)
    out = np.where(np.isnan(values), np.uint32(0x7FC00000), out)
    return out.astype(np.uint32).view(np.float32)


def quantize_fp16(v: Column | str) -> Column:
    @F.arrow_udf("array<float>")
    def halves(rows: pa.Array) -> pa.Array:
        values, n, valid = flat.flattened(rows)
        return flat.lists(half(values.astype(np.float32)), n, valid)

    return halves(_col(v))


def quantize(v: Column | str, kind: str) -> Column:
    quantization_info(kind)
    return {"int8": quantize_int8, "uint8": quantize_uint8, "binary": quantize_binary, "fp16": quantize_fp16}[kind](v)


def dequantize(codes: Column | str, kind: str, dimensions: int | None = None) -> Column:
    """int8 / 127, uint8 / 255, bits to -1 and 1 (the first ``dimensions``), halves as they are."""
    quantization_info(kind)
    c = _col(codes)
    if kind == "fp16":
        return c.cast("array<float>")
    if kind in ("int8", "uint8"):
        return F.transform(c, lambda x: x / F.lit(127.0 if kind == "int8" else 255.0)).cast("array<float>")

    @F.arrow_udf("array<float>")
    def signs(b: pa.Array) -> pa.Array:
        data, n, valid = flat.bytes_of(b)
        bits = np.where(valid, n * 8 if dimensions is None else dimensions, 0)
        if (bits > n * 8).any():
            raise ValidationError(f"codes have fewer than {dimensions} bits")
        found = np.unpackbits(data)[flat.places((np.cumsum(n) - n) * 8, bits)]
        return flat.lists(found.astype(np.float32) * 2 - 1, bits, valid)

    return signs(c)


def estimate_memory(dimensions: Column | int, count: Column | int, kind: str) -> Column:
    """(original_bytes, quantized_bytes, savings): halves are held as floats and save nothing."""
    quantization_info(kind)
    d = F.lit(dimensions) if isinstance(dimensions, int) else dimensions
    n = F.lit(count) if isinstance(count, int) else count
    each = {"fp16": d * 4, "int8": d, "uint8": d, "binary": F.ceil(d / 8)}[kind]
    return F.struct((d * 4 * n).cast("bigint").alias("original_bytes"), (each * n).cast("bigint").alias("quantized_bytes"), F.coalesce(F.try_divide(d * 4 * n - each * n, d * 4 * n), F.lit(0.0)).alias("savings"))


def sign_words(v: Column | str, dimensions: int) -> Column:
    """The sign bits as 64-bit words, for Hamming distances inside the JVM."""
    v = _col(v)
    words = [F.aggregate(F.transform(F.slice(v, 64 * w + 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x)) for w in range(-(-dimensions // 64))]
    return F.array(*words)


def hamming_distance(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two arrays of words."""
    same = F.size(_col(a)) == F.size(_col(b))
    n = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(same, n).otherwise(F.raise_error(F.lit("codes differ in length")).cast("int"))


def hamming_similarity(a: Column | str, b: Column | str, dimensions: int) -> Column:
    return 1 - hamming_distance(a, b) / F.lit(dimensions)


def hamming_bytes(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two binary codes, JVM-side on their hexadecimal digits."""
    a, b = _col(a), _col(b)
    digit = lambda c, i: F.conv(F.substring(F.hex(c), i, F.lit(1)), 16, 10).cast("int")
    steps = F.when(F.length(a) > 0, F.sequence(F.lit(1), F.length(a) * 2)).otherwise(F.array().cast("array<int>"))
    n = F.aggregate(steps, F.lit(0), lambda s, i: s + F.bit_count(digit(a, i).bitwiseXOR(digit(b, i))))
    return F.when(F.length(a) == F.length(b), n).otherwise(F.raise_error(F.lit("codes differ in length")).cast("int"))


def calibrate(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row (low, high, dimensions): the range of every dimension."""
    flat = df.select(F.posexplode(_col(vector)).alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    pairs = F.array_sort(F.collect_list(F.struct("pos", "lo", "hi")))
    out = flat.agg(pairs.alias("p")).where("size(p) > 0")
    return out.select(F.transform("p", lambda x: x["lo"]).cast("array<float>").alias("low"), F.transform("p", lambda x: x["hi"]).cast("array<float>").alias("high"), F.size("p").alias("dimensions"))


def calibrated_quantize(v: Column | str, low: Column | str, high: Column | str) -> Column:
    """round(clamp((x - low) / (high - low), 0, 1) * 255); 128 where a dimension has no range."""
    low, high = wide(low), wide(high)

    def code(x: Column, i: Column) -> Column:
        lo, hi = F.element_at(low, i + 1), F.element_at(high, i + 1)
        return F.when(hi == lo, 128).otherwise(_half_up(_clamp(F.try_divide(x - lo, hi - lo), 0.0, 1.0) * 255)).cast("smallint")

    return F.when(F.size(_col(v)) == F.size(low), F.transform(wide(v), code)).otherwise(F.raise_error(F.lit("the calibration has other dimensions")).cast("array<smallint>"))


def calibrated_dequantize(codes: Column | str, low: Column | str, high: Column | str) -> Column:
    low, high = wide(low), wide(high)
    return F.transform(_col(codes), lambda b, i: F.element_at(low, i + 1) + b / F.lit(255.0) * (F.element_at(high, i + 1) - F.element_at(low, i + 1))).cast("array<float>")


def hamming_top_k(df: DataFrame, k: int, dimensions: int, key: str = "vec_id", vector: str = "embedding", queries: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, distance, similarity): for every row (or every one of ``queries``) the k others with the nearest sign codes.

    Codes are compared by tiles, as products of their signs; ties go to the lesser id.
    """
    from pyspark.sql import Window

    from lodevec.operators import blocks

    own = blocks.packed(df, key, vector)
    asked = own if queries is None else blocks.packed(queries, key, vector)
    signs = lambda v: np.where(v > 0, np.float32(1), np.float32(-1))
    pairs = blocks.best_of(asked, own, lambda a, b: (signs(a) @ signs(b).T - a.shape[1]) / 2, k, others=True)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    pairs = pairs.select("query_id", "id", (-F.col("score")).cast("bigint").alias("distance"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k).withColumn("similarity", 1 - F.col("distance") / dimensions)
