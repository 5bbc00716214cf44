"""Distances and vector arithmetic as column expressions, accumulated in doubles."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vector(values: list[float]) -> Column:
    return F.lit([float(x) for x in values])


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def _d(c: Column) -> Column:
    return c.cast("array<double>")


def dot_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot_product(a, a))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(_d(a), lambda x: x / n)).otherwise(_d(a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.greatest(F.lit(0.0), 1 - F.when(n > 0, dot_product(a, b) / n).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    return -dot_product(a, b)


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_d(a), _d(b), lambda x, y: F.abs(x - y)))


def hamming(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.when(x == y, 0.0).otherwise(1.0)))


METRICS = {"cosine": cosine, "dot": dot, "l2-squared": l2_squared, "manhattan": manhattan, "hamming": hamming}


def distance(metric: str, a: Column, b: Column) -> Column:
    """A length mismatch is an error, as is an unknown metric."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    same = F.size(a) == F.size(b)
    return F.when(same, METRICS[metric](a, b)).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vector lengths don't match")).cast("double"))


def normalized_distance(a: Column, b: Column) -> Column:
    """(1 - cos) / 2, between 0 and 1."""
    n = norm(a) * norm(b)
    return (1 - F.when(n > 0, dot_product(a, b) / n).otherwise(0.0)) / 2


def certainty(dist: Column) -> Column:
    return 1 - dist / 2


def certainty_to_distance(c: float) -> float:
    return (1 - c) * 2


def move_to(source: Column, target: Column, force: float) -> Column:
    if not 0 <= force <= 1:
        raise ValueError("force must be between 0 and 1")
    return F.zip_with(_d(source), _d(target), lambda s, t: s * (1 - force / 2) + t * (force / 2))


def move_away(source: Column, target: Column, force: float) -> Column:
    if force < 0:
        raise ValueError("force must not be negative")
    return F.zip_with(_d(source), _d(target), lambda s, t: s + force / 2 * (s - t))


def centroid(df: DataFrame, vec: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """Element-wise mean; with weights, a weighted sum over the plain count."""
    w = F.col(weight) if weight else F.lit(1.0)
    parts = df.select(*by, w.alias("_w"), F.posexplode(vec).alias("_pos", "_x"))
    means = parts.groupBy(*by, "_pos").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.count(F.lit(1))).alias("_m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda s: s["_m"]).alias(vec))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on a sphere of 6,371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371000.0 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def cosine_batches(df: DataFrame, vec: str, query: list[float], out: str = "_distance") -> DataFrame:
    """Cosine distances of many rows to one query by Arrow batches and numpy: one matrix product a batch."""
    import numpy as np
    import pyarrow as pa

    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)
    at = df.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col, got = b.column(at), np.full(b.num_rows, np.nan)
            ok = np.flatnonzero(np.asarray(col.is_valid()))
            if len(ok):
                m = np.asarray(col.drop_null().flatten(), np.float64).reshape(len(ok), -1)
                n = np.linalg.norm(m, axis=1)
                got[ok] = np.maximum(0, 1 - (m @ q) / np.where(n > 0, n, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, from_pandas=True)], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField(out, T.DoubleType())]))
