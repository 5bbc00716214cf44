"""Typed aggregations: one row, or one row of each group, all aggregators in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP_LIMIT, TOP = 100, 5


def _element(df: DataFrame, prop: str) -> T.DataType:
    kind = df.schema[prop].dataType
    return kind.elementType if isinstance(kind, T.ArrayType) else kind


def checked(df: DataFrame, prop: str) -> T.DataType:
    kind = _element(df, prop)
    if isinstance(kind, (T.StructType, T.BinaryType, T.MapType)):
        raise ValueError(f"{prop} can't be aggregated")
    return kind


def numeric(c: Column | str, p: str) -> list[Column]:
    """count, sum, minimum, maximum, mean, mode (ties: the lowest), median (exact)."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return [F.count(x).alias(f"{p}_count"), F.sum(x).alias(f"{p}_sum"), F.min(x).alias(f"{p}_minimum"), F.max(x).alias(f"{p}_maximum"), F.avg(x).alias(f"{p}_mean"), F.mode(x, True).alias(f"{p}_mode"), F.median(x).alias(f"{p}_median")]


def boolean(c: Column | str, p: str) -> list[Column]:
    x = F.col(c) if isinstance(c, str) else c
    n, yes = F.count(x), F.count_if(x)
    share = lambda k: F.when(n > 0, k / n).otherwise(0.0)
    return [n.alias(f"{p}_count"), yes.alias(f"{p}_total_true"), F.count_if(~x).alias(f"{p}_total_false"), share(yes).alias(f"{p}_percentage_true"), share(F.count_if(~x)).alias(f"{p}_percentage_false")]


def date(c: str, p: str) -> list[Column]:
    """Moments as microseconds; the median of an even count lies midway; of equal modes the earliest."""
    x = F.unix_micros(F.col(c).cast("timestamp"))
    at = lambda y, name: F.timestamp_micros(y.cast("long")).alias(f"{p}_{name}")
    return [F.count(x).alias(f"{p}_count"), at(F.min(x), "minimum"), at(F.max(x), "maximum"), at(F.mode(x, True), "mode"), at(F.floor(F.median(x)), "median")]


def reference(c: str, p: str) -> list[Column]:
    return [F.array_sort(F.collect_set(c)).alias(f"{p}_pointing_to")]


def top_occurrences(df: DataFrame, prop: str, by: list[str] = (), limit: int = TOP) -> DataFrame:
    """(group, value, occurs): most frequent values, ties by value."""
    from pyspark.sql import Window

    kind = df.schema[prop].dataType
    value = F.explode(prop) if isinstance(kind, T.ArrayType) else F.col(prop)
    counts = df.select(*by, value.alias("value")).where("value is not null").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("occurs"))
    if not by:
        return counts.orderBy(F.desc("occurs"), "value").limit(limit)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("occurs"), "value"))
    return counts.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


def declared(df: DataFrame, p: str) -> list[Column]:
    """The property's type by its declared name."""
    kind = _element(df, p)
    name = {"string": "text", "boolean": "boolean", "timestamp": "date", "timestamp_ntz": "date", "date": "date"}.get(kind.simpleString())
    name = name or ("int" if isinstance(kind, T.IntegralType) else "number" if isinstance(kind, T.NumericType) else "object")
    return [F.lit(name + "[]" * isinstance(df.schema[p].dataType, T.ArrayType)).alias(f"{p}_type")]


def aggregate(df: DataFrame, props: dict[str, str] | None = None, group_by: str | None = None, limit: int = GROUP_LIMIT) -> DataFrame:
    """props: name -> numeric, boolean, date, text_count, reference or type. Array properties count by element, groups by distinct element."""
    if group_by is not None and "." in group_by:
        raise ValueError("groups by nested paths are not supported")
    if group_by is not None:
        kind = df.schema[group_by].dataType
        df = df.withColumn("_group", F.explode(F.array_distinct(group_by)) if isinstance(kind, T.ArrayType) else F.col(group_by)).where("_group is not null")
    keys = ["_group"] if group_by else []
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("meta_count"))
    plain, exploded = [], []
    for p, how in (props or {}).items():
        if how == "type":
            plain += [F.first(c).alias(f"{p}_type") for c in declared(df, p)]
            continue
        checked(df, p)
        cols = {"numeric": numeric, "boolean": boolean, "date": date, "reference": reference, "text_count": lambda c, p: [F.count(F.col(c)).alias(f"{p}_count")]}[how](p, p)
        if isinstance(df.schema[p].dataType, T.ArrayType) and how != "reference":
            x = df.select(*keys, F.explode(p).alias(p))
            exploded.append(x.groupBy(*keys).agg(*cols))
        else:
            plain += cols
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("meta_count"), *plain) if plain else total
    for x in exploded:
        out = out.join(x, keys, "left") if keys else out.join(F.broadcast(x), how="cross")  # one row each
    if group_by:
        out = out.orderBy(F.desc("meta_count"), "_group").limit(limit)
    return out


def dimensions(df: DataFrame, vecs: list[str]) -> DataFrame:
    """Vectors and dimensions stored for each named vector."""
    from functools import reduce

    return reduce(lambda a, b: a.union(b), (df.agg(F.lit(v).alias("target"), F.count(v).alias("objects"), F.coalesce(F.sum(F.size(v).cast("long")), F.lit(0)).alias("dimensions")) for v in vecs))
