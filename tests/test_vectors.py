import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodevec.errors import DimensionMismatchError, ValidationError
from lodevec.functions import quantization as Q
from lodevec.functions import vector as V
from lodevec.rng import generator, permutation, projection_matrix


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} array<float>" for n in names))
    return df.select(expr.alias("x")).first().x


def test_scores_of_known_vectors(spark):
    a, b = [1.0, 2.0, 3.0], [4.0, 5.0, 6.0]
    assert one(spark, V.dot("a", "b"), a=a, b=b) == 32
    assert one(spark, V.euclidean("a", "b"), a=[0.0, 0.0], b=[3.0, 4.0]) == 5
    assert one(spark, V.manhattan("a", "b"), a=[0.0, 0.0], b=[3.0, 4.0]) == 7
    assert one(spark, V.score("a", "b", "euclidean"), a=[0.0, 0.0], b=[3.0, 4.0]) == pytest.approx(1 / 6)
    assert one(spark, V.score("a", "b", "manhattan"), a=[0.0, 0.0], b=[3.0, 4.0]) == pytest.approx(1 / 8)
    assert one(spark, V.cosine("a", "b"), a=[0.0, 0.0], b=[1.0, 0.0]) == 0
    assert one(spark, V.distance("a", "b", "dot"), a=a, b=b) == -31
    assert one(spark, V.cosine("a", "b"), a=[1.0, 0.0], b=[-1.0, 0.0]) == -1


def test_nulls_and_lengths(spark):
    assert one(spark, V.cosine("a", "b"), a=None, b=[1.0]) is None
    assert one(spark, V.dot("a", "b"), a=None, b=None) is None
    with pytest.raises(Exception, match="differ in length"):
        one(spark, V.dot("a", "b"), a=[1.0], b=[1.0, 2.0])
    with pytest.raises(ValidationError):
        V.score("a", "b", "chebyshev")


def test_unit_length_and_truncation(spark):
    assert one(spark, V.normalize("a"), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, V.normalize("a"), a=[0.0, 0.0]) == [0, 0]
    assert one(spark, V.truncate_dimensions("a", 2), a=[3.0, 4.0, 9.0]) == pytest.approx([0.6, 0.8])
    with pytest.raises(ValidationError):
        V.truncate_dimensions("a", 0)
    with pytest.raises(Exception, match="fewer than"):
        one(spark, V.truncate_dimensions("a", 4), a=[1.0])
    assert one(spark, V.is_normalized("a"), a=[1.0, 0.0]) and not one(spark, V.is_normalized("a"), a=[1.0, 0.1])


def test_dimensions_are_checked(spark):
    df = spark.createDataFrame([(2, [1.0, 2.0]), (1, [1.0]), (3, [3.0])], "vec_id long, embedding array<float>")
    assert tuple(V.validate_dimensions(df).first()) == (False, 1, [2])
    assert tuple(V.validate_dimensions(df.limit(0)).first()) == (True, 0, [])
    with pytest.raises(DimensionMismatchError):
        V.check_dimensions(df)
    with pytest.raises(ValidationError):
        V.check_dimensions(df.limit(0))


@settings(max_examples=30, deadline=None)
@given(st.integers(-(2**31), 2**31 - 1), st.integers(0, 50))
def test_permutations_are_permutations(seed, n):
    assert sorted(permutation(n, seed)) == list(range(n))


def test_generator_keeps_the_sign_in_its_shift():
    x, draws = 42, []
    for _ in range(5):  # the definition, written out with explicit 32-bit signed steps
        x = (x ^ (x << 13)) & 0xFFFFFFFF
        signed = x - 2**32 if x >= 2**31 else x
        x = (signed ^ (signed >> 17)) & 0xFFFFFFFF
        x = (x ^ (x << 5)) & 0xFFFFFFFF
        draws.append(x / 2**32)
    g = generator(42)
    assert [g() for _ in range(5)] == draws
    assert generator(0)() == generator(1)()


def test_projection_keeps_distances():
    r = np.random.default_rng(0)
    v, m = r.normal(size=(60, 512)), projection_matrix(512, 128).astype(float)
    p = v @ m.T
    pairs = [(i, j) for i in range(60) for j in range(i)]
    ratio = [np.linalg.norm(p[i] - p[j]) / np.linalg.norm(v[i] - v[j]) for i, j in pairs]
    assert np.mean([0.7 < x < 1.3 for x in ratio]) > 0.8


def test_quantisation_rounds_halves_upwards(spark):
    assert one(spark, Q.quantize("a", "int8"), a=[-2.0, -2.5 / 127, 0.0, 1.0, float("nan")]) == [-127, -2, 0, 127, 0]
    assert one(spark, Q.quantize("a", "uint8"), a=[-1.0, 0.5, 2.0]) == [0, 128, 255]
    assert bytes(one(spark, Q.quantize("a", "binary"), a=[1.0, -1.0, 0.0, 2.0, 0.0, 0.0, 0.0, 1.0, 1.0])) == bytes([0b10010001, 0b10000000])
    back = one(spark, Q.dequantize(Q.quantize("a", "binary"), "binary", 9), a=[1.0, -1.0, 0.0, 2.0, 0.0, 0.0, 0.0, 1.0, 1.0])
    assert back == [1, -1, -1, 1, -1, -1, -1, 1, 1]
    with pytest.raises(ValidationError):
        Q.quantize("a", "int4")


def test_half_precision_cuts_the_mantissa():
    x = np.array([1 + 2**-11, 1e-8, -1e-8, 100000.0, -100000.0, np.inf, np.nan, 65504.0], np.float32)
    y = Q.half(x)
    assert y[0] == 1 and y[1] == 0 and math.copysign(1, y[2]) == -1 and y[2] == 0
    assert y[3] == np.inf and y[4] == -np.inf and y[5] == np.inf and np.isnan(y[6]) and y[7] == 65504


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-60000, 60000, width=32), min_size=1, max_size=20))
def test_half_precision_is_near(values):
    x = np.array(values, np.float32)
    y = Q.half(x)
    big = np.abs(x) >= 2**-14
    assert (np.abs(y[big] - x[big]) <= np.abs(x[big]) * 2**-10).all() and (y[~big] == 0).all()


def test_calibration(spark):
    df = spark.createDataFrame([(1, [0.0, 5.0]), (2, [1.0, 5.0]), (3, [0.5, 5.0])], "vec_id long, embedding array<float>")
    cal = Q.calibrate(df)
    assert tuple(cal.first()) == ([0, 5], [1, 5], 2)
    both = df.crossJoin(cal)
    codes = {r.vec_id: r.c for r in both.select("vec_id", Q.calibrated_quantize("embedding", "low", "high").alias("c")).collect()}
    assert codes == {1: [0, 128], 2: [255, 128], 3: [128, 128]}
    back = both.select("vec_id", Q.calibrated_dequantize(Q.calibrated_quantize("embedding", "low", "high"), "low", "high").alias("v")).collect()
    assert {r.vec_id: r.v[1] for r in back} == {1: 5, 2: 5, 3: 5}
    assert Q.calibrate(df.limit(0)).count() == 0


def test_hamming(spark):
    df = spark.createDataFrame([(bytes([0xFF, 0]), bytes([0, 0xFF])), (b"\xaa", b"\xab"), (b"", b"")], "a binary, b binary")
    assert [r.d for r in df.select(Q.hamming_bytes("a", "b").alias("d")).collect()] == [16, 1, 0]
    words = spark.createDataFrame([([1.0] * 70, [-1.0] * 69 + [1.0])], "a array<float>, b array<float>").select(Q.sign_words("a", 70).alias("a"), Q.sign_words("b", 70).alias("b"))
    assert words.select(Q.hamming_distance("a", "b").alias("d"), Q.hamming_similarity("a", "b", 70).alias("s")).first().asDict() == {"d": 69, "s": 1 - 69 / 70}


def test_memory_estimates(spark):
    got = {k: tuple(spark.range(1).select(Q.estimate_memory(10, 100, k).alias("m")).first().m) for k in Q.INFO}
    assert got == {"fp16": (4000, 4000, 0.0), "int8": (4000, 1000, 0.75), "uint8": (4000, 1000, 0.75), "binary": (4000, 200, 0.95)}


def test_vector_columns(spark):
    df = spark.createDataFrame([(1, [1.0], "a")], "i long, v array<double>, s string")
    assert V.is_vector(df.schema, "v") and not V.is_vector(df.schema, "s")
    assert df.select(V.to_float32("v").alias("f")).schema["f"].dataType.simpleString() == "array<float>"
    assert df.select(F.size(V.add("v", "v")).alias("n")).first().n == 1
