"""References between collections: resolution (outer lookup), counts, centroids of what is referenced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resolve(df: DataFrame, column: str, target: DataFrame, key: str, fields: list[str], out: str) -> DataFrame:
    """df with ``out``: the target's fields as a struct, or an array of structs for an array of keys, in the keys' order.

    Rows meet their lists again by a digest of the keys, as numbers given to rows may differ when these are computed again.
    """
    right = target.select(F.col(key).alias("_k"), F.struct(*fields).alias(out))
    if not isinstance(df.schema[column].dataType, T.ArrayType):
        return df.join(right, F.col(column) == F.col("_k"), "left").drop("_k")
    rows = df.withColumn("_row", F.unhex(F.sha2(F.to_json(F.struct(F.col(column).alias("k"))), 256)))
    each = rows.select("_row", column).dropDuplicates(["_row"]).select("_row", F.posexplode_outer(column).alias("_pos", "_k")).join(right, "_k", "left")
    lists = each.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col(out).isNotNull(), F.struct("_pos", out)))), lambda s: s[out]).alias(out))
    return rows.join(lists, "_row", "left").drop("_row")


def resolve_many(df: DataFrame, column: str, targets: dict[str, tuple[DataFrame, str]], fields: list[str], out: str) -> DataFrame:
    """A reference that may point into several collections: struct (class, id) -> the fields that all of them have."""
    every = reduce(lambda a, b: a.unionByName(b), (t.select(F.lit(name).alias("_c"), F.col(k).alias("_k"), F.struct(*fields).alias(out)) for name, (t, k) in targets.items()))
    return df.join(every, (F.col(column)["class"] == F.col("_c")) & (F.col(column)["id"] == F.col("_k")), "left").drop("_c", "_k")


def count(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("_ref_count", F.coalesce(F.size(column), F.lit(0)))


def centroids(df: DataFrame, id_col: str, refs: str, target: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, vector): the mean of the vectors of all referenced objects; null where there are none."""
    from lodestone.functions.distance import centroid

    each = df.select(id_col, F.explode(refs).alias("_k")).join(target.select(F.col(key).alias("_k"), vec), "_k")
    return df.select(id_col).join(centroid(each, vec, [id_col]), id_col, "left")
