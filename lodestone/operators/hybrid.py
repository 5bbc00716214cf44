"""Rank fusion of keyword and vector hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK_OFFSET = 60
ALPHA = 0.75


def _merge(parts: list[DataFrame], id_col: str) -> DataFrame:
    every = reduce(lambda a, b: a.unionByName(b), parts)
    out = every.groupBy(id_col).agg(F.sum("part").alias("s"), F.max("raw").alias("_secondary"), F.array_join(F.array_sort(F.collect_list("why")), "; ").alias("explain"))
    # Scores that differ in the eighth digit only count as equal; then the raw score, then the larger id.
    return out.withColumnRenamed("s", "score").orderBy(F.desc(F.round("score", 7)), F.desc("_secondary"), F.desc(id_col))


def _why(name: str) -> F.Column:
    return F.format_string(f"{name} %.6f", F.col("part"))


#: Ranges of scores in which hits are numbered side by side.
RANGES = 64


def with_rank(hits: DataFrame, id_col: str, ranges: int = RANGES) -> DataFrame:
    """``_place``: places from 0 by falling score, ties by id. Ranges of scores are numbered each in its own partition and
    moved on by the counts of those above, so no partition holds all hits."""
    share = [i / ranges for i in range(1, ranges)]
    cuts = hits.agg(F.percentile_approx("score", share, F.lit(10_000)).alias("_cuts"))  # one row
    cut = hits.join(F.broadcast(cuts), how="cross").withColumn("_range", F.size(F.filter("_cuts", lambda c: c > F.col("score")))).drop("_cuts")
    counts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")  # a row for each range
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("score"), id_col)) - 1
    return cut.withColumn("_place", rank).join(F.broadcast(before), "_range").withColumn("_place", F.col("_place") + F.col("_before")).drop("_range", "_before")


def ranked(legs: list[tuple[str, DataFrame, float]], id_col: str) -> DataFrame:
    """Reciprocal ranks: weight / (60 + rank from 0), summed. Legs: (name, hits with score, weight)."""
    return _merge([with_rank(hits, id_col).withColumn("raw", F.col("score")).withColumn("part", F.lit(float(w)) / (RANK_OFFSET + F.col("_place"))).withColumn("why", _why(name)).select(id_col, "part", "raw", "why") for name, hits, w in legs if w > 0], id_col)


def relative(legs: list[tuple[str, DataFrame, float]], id_col: str) -> DataFrame:
    """Scores of each leg spread over 0 to its weight, summed; a leg of equal scores gives its weight to all."""
    parts = []
    for name, hits, w in legs:
        if w <= 0:
            continue
        ends = hits.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
        part = F.when(F.col("_hi") > F.col("_lo"), w * (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(float(w)))
        parts.append(hits.join(F.broadcast(ends), how="cross").withColumn("raw", F.col("score")).withColumn("part", part).withColumn("why", _why(name)).select(id_col, "part", "raw", "why"))
    return _merge(parts, id_col)


def hybrid(keyword: DataFrame, vector: DataFrame, id_col: str, alpha: float = ALPHA, fusion: str = "relative", limit: int | None = None, offset: int = 0, leg_limit: int | None = None, max_distance: float | None = None) -> DataFrame:
    """keyword: (id, score); vector: (id, _distance). The vector leg scores 1 - distance; alpha 0 or 1 runs one leg alone.

    Legs are taken whole; a leg_limit keeps the first hits of each.
    """
    if max_distance is not None:
        vector = vector.where(F.col("_distance") <= max_distance)
        keyword = keyword.join(vector.select(id_col), id_col, "left_semi")
    v, k = vector.select(id_col, (1 - F.col("_distance")).alias("score")), keyword.select(id_col, "score")
    if leg_limit is not None:
        v, k = (leg.orderBy(F.desc("score"), id_col).limit(max(leg_limit, limit or 0)) for leg in (v, k))
    legs = [("vector", v, alpha), ("keyword", k, 1 - alpha)]
    out = (relative if fusion == "relative" else ranked)(legs, id_col)
    return out.offset(offset).limit(limit) if limit is not None else out
