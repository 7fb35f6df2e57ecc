"""Vector arithmetic as Column expressions over ``array<float>`` or ``array<double>``; sums are in doubles.

A null vector gives null. Vectors of different lengths that belong together raise an error in the job
(``check_dimensions`` finds them beforehand).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodevec.errors import DimensionMismatchError, ValidationError

METRICS = ("cosine", "dot", "euclidean", "manhattan")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wide(c: Column | str) -> Column:
    return _col(c).cast("array<double>")


def to_float32(c: Column | str) -> Column:
    return _col(c).cast("array<float>")


def is_vector(schema: T.StructType, name: str) -> bool:
    """Whether a column is an array of numbers."""
    kind = schema[name].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)


def literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def _aligned(a: Column, b: Column, out: Column) -> Column:
    return F.when(F.size(a) == F.size(b), out).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors differ in length")).cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = wide(a), wide(b)
    return _aligned(a, b, _total(F.zip_with(a, b, lambda x, y: x * y)))


def magnitude(v: Column | str) -> Column:
    v = wide(v)
    return F.sqrt(_total(F.transform(v, lambda x: x * x)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    return F.when(_col(a).isNotNull() & _col(b).isNotNull(), F.coalesce(F.try_divide(dot(a, b), magnitude(a) * magnitude(b)), F.lit(0.0)))


def euclidean(a: Column | str, b: Column | str) -> Column:
    a, b = wide(a), wide(b)
    return _aligned(a, b, F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))


def manhattan(a: Column | str, b: Column | str) -> Column:
    a, b = wide(a), wide(b)
    return _aligned(a, b, _total(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - cosine(a, b)


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValidationError(f"unknown metric {metric!r}; known are {', '.join(METRICS)}")
    return metric


def score(a: Column | str, b: Column | str, metric: str = "cosine") -> Column:
    """Similarity: cosine, dot, or 1 / (1 + distance)."""
    check_metric(metric)
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot":
        return dot(a, b)
    return 1 / (1 + (euclidean(a, b) if metric == "euclidean" else manhattan(a, b)))


def distance(a: Column | str, b: Column | str, metric: str = "cosine") -> Column:
    """1 - cosine, 1 - dot (which may be negative), or the Euclidean or Manhattan distance."""
    check_metric(metric)
    if metric in ("cosine", "dot"):
        return 1 - (cosine(a, b) if metric == "cosine" else dot(a, b))
    return euclidean(a, b) if metric == "euclidean" else manhattan(a, b)


def normalize(v: Column | str) -> Column:
    """Unit length; a zero vector stays zero. The norm is computed once a row."""
    v = wide(v)
    return F.element_at(F.transform(F.array(magnitude(v)), lambda n: F.transform(v, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))), 1).cast("array<float>")


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(wide(a), wide(b), lambda x, y: x + y).cast("array<float>")


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(wide(a), wide(b), lambda x, y: x - y).cast("array<float>")


def scale(v: Column | str, by: float | Column) -> Column:
    return F.transform(wide(v), lambda x: x * by).cast("array<float>")


def is_normalized(v: Column | str, tolerance: float = 1e-6) -> Column:
    return F.abs(magnitude(v) - 1) <= tolerance


def truncate_dimensions(v: Column | str, n: int) -> Column:
    """The first n dimensions, then unit length again."""
    if n <= 0:
        raise ValidationError("the number of dimensions must be positive")
    v = _col(v)
    return F.when(F.size(v) >= n, normalize(F.slice(v, 1, n))).when(v.isNotNull(), F.raise_error(F.lit(f"a vector has fewer than {n} dimensions")).cast("array<float>"))


def validate_dimensions(df: DataFrame, expected: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row (valid, dimension, mismatches); the dimension expected is by default that of the least key."""
    size = F.size(vector)
    want = F.lit(expected) if expected is not None else F.min_by(size, key)
    first = df.agg(F.coalesce(want, F.lit(0)).alias("dimension"))
    bad = df.select(F.col(key).alias("__k"), size.alias("__n")).crossJoin(F.broadcast(first)).where("__n <> dimension")
    found = bad.agg(F.sort_array(F.collect_list("__k")).alias("mismatches"))
    return first.crossJoin(found).select((F.size("mismatches") == 0).alias("valid"), "dimension", "mismatches")


def check_dimensions(df: DataFrame, vector: str = "embedding") -> int:
    """The common length of all vectors; raises where there is none or they differ."""
    seen = df.agg(F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high")).first()
    if seen.low is None:
        raise ValidationError("there is no vector")
    if seen.low != seen.high:
        raise DimensionMismatchError(f"vectors have {seen.low} to {seen.high} dimensions")
    if seen.low < 1:
        raise ValidationError("vectors are empty")
    return seen.low
