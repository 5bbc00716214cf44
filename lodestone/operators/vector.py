"""Vector search: k nearest, within a distance, by object, by text, over several targets, over token vectors.

Distances are doubles as computed; nothing is ranked by rounded ones.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import distance as D

SAME = 1e-6


def with_distance(df: DataFrame, vec: str, query: list[float] | Column, metric: str = "cosine", out: str = "_distance") -> DataFrame:
    q = D.vector(query) if isinstance(query, (list, tuple)) else query
    return df.withColumn(out, D.distance(metric, F.col(vec), q))


def knn(df: DataFrame, vec: str, query, k: int, id_col: str, metric: str = "cosine") -> DataFrame:
    """The k nearest rows, ties by id. Filters belong before this call, so they bound what is searched."""
    return with_distance(df.where(F.col(vec).isNotNull()), vec, query, metric).orderBy("_distance", id_col).limit(k)


def within(df: DataFrame, vec: str, query, most: float, id_col: str, metric: str = "cosine", maximum: int | None = None) -> DataFrame:
    """All rows at most so far away, or the nearest ``maximum`` of them if that is given."""
    near = with_distance(df.where(F.col(vec).isNotNull()), vec, query, metric).where(F.col("_distance") <= most)
    near = near.orderBy("_distance", id_col)
    return near.limit(maximum) if maximum is not None else near


#: Bounds are compared with so much room for the last digits of doubles.
SLACK = 1e-7


def least_cosine(c: Column, turn: Column) -> Column:
    """The least cosine distance of a row to a query from their cosines to a third vector: angles differ by their difference at least."""
    c = F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))
    return 1 - (c * turn + F.sqrt((1 - c * c) * F.greatest(1 - turn * turn, F.lit(0.0))))


def still_near(df: DataFrame, least: Column, first: DataFrame, k: int) -> DataFrame:
    """Rows whose least distance doesn't exceed that of the k-th of some first hits, so that the k nearest are among them."""
    edge = first.agg(F.when(F.count(F.lit(1)) >= k, F.max("_distance")).alias("_edge"))  # one row
    rows = df.withColumn("_least", least).join(F.broadcast(edge), how="cross")
    return rows.where(~F.coalesce(F.col("_least") > F.col("_edge") + SLACK, F.lit(False))).drop("_least", "_edge")


def keep_certain(hits: DataFrame, certainty: float | None = None, distance: float | None = None) -> DataFrame:
    if certainty is not None:
        hits = hits.where(D.certainty(F.col("_distance")) >= certainty)
    if distance is not None:
        hits = hits.where((F.col("_distance") <= distance) | (F.abs(F.col("_distance") - distance) <= SAME))
    return hits


def with_distance_to(df: DataFrame, vec: str, one: DataFrame, metric: str = "cosine") -> DataFrame:
    """Distances to the vector ``_q`` of a table of one row, which is broadcast; no rows if it has none."""
    rows = df.where(F.col(vec).isNotNull()).join(F.broadcast(one.limit(1)), how="cross")
    return with_distance(rows, vec, F.col("_q"), metric).drop("_q")


def vector_of(df: DataFrame, vec: str, object_id, id_col: str) -> DataFrame:
    """A stored object's vector as a table of one row, or none."""
    return df.where((F.col(id_col) == object_id) & F.col(vec).isNotNull()).select(F.col(vec).alias("_q"))


def near_object(df: DataFrame, vec: str, object_id, k: int, id_col: str, metric: str = "cosine") -> DataFrame:
    """Nearest to a stored object, which is itself among the hits; no hits if there is no such object."""
    return with_distance_to(df, vec, vector_of(df, vec, object_id, id_col), metric).orderBy("_distance", id_col).limit(k)


#: Queries and base rows of one tile; with 1,024 dimensions a tile's base rows take 64 MB.
TILE_QUERIES, TILE_ROWS = 512, 8192


def tile_distances(metric: str, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all queries to all base rows, in doubles."""
    if metric in ("cosine", "dot"):
        product = q @ b.T
        # In a matrix product equal vectors may differ in the last digits by their place, so these are cut off.
        if metric == "dot":
            return np.round(-product, 12)
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
        return np.round(np.maximum(0.0, 1 - np.where(n > 0, product / np.where(n > 0, n, 1), 0.0)), 12)
    each = {"l2-squared": lambda d: (d * d).sum(1), "manhattan": lambda d: np.abs(d).sum(1), "hamming": lambda d: (d != 0).sum(1).astype(np.float64)}[metric]
    return np.stack([each(b - x) for x in q]) if len(q) else np.zeros((0, len(b)))


def best_of_tile(queries: pd.DataFrame, base: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    """(query_id, base_id, _distance): each query's k nearest of a tile, ties to the smaller id.

    Distances are computed for TILE_QUERIES queries at a time, so a tile of many queries takes no more memory for them.
    """
    if len(queries) > TILE_QUERIES:
        return pd.concat([best_of_tile(queries.iloc[at : at + TILE_QUERIES], base, k, metric) for at in range(0, len(queries), TILE_QUERIES)], ignore_index=True)
    parts = []
    if len(queries) and len(base):
        order = np.argsort(base.base_id.to_numpy(), kind="stable")
        ids = base.base_id.to_numpy()[order]
        d = tile_distances(metric, np.stack(queries._q.to_list()).astype(np.float64), np.stack(base._v.to_list()).astype(np.float64)[order])
        if len(ids) > k:
            edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            parts = [(q, np.flatnonzero(row <= e)) for q, row, e in zip(range(len(d)), d, edge[:, 0], strict=True)]
            parts = [(q, at[np.argsort(d[q, at], kind="stable")[:k]]) for q, at in parts]
        else:
            parts = [(q, np.arange(len(ids))) for q in range(len(d))]
    rows = [(np.full(len(at), queries.query_id.to_numpy()[q]), ids[at], d[q, at]) for q, at in parts]
    cols = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]
    return pd.DataFrame(dict(zip(("query_id", "base_id", "_distance"), cols, strict=True)))


def nearest_of_each(queries: DataFrame, base: DataFrame, k: int, query_id: str, base_id: str, query_vec: str, base_vec: str, metric: str = "cosine", tile_queries: int = TILE_QUERIES, tile_rows: int = TILE_ROWS, most: int | None = None) -> DataFrame:
    """(query_id, base_id, _distance, _rank): the k nearest base rows of every query row, ties to the smaller id.

    Both sides are dealt by a hash into blocks of bounded size, sized by their counts; a tile is a pair of blocks and one
    matrix product, so tasks grow in number and not in size. Each tile keeps k hits a query, which one window merges. Rows
    without a vector take no part. most: a known upper bound of the queries' number, which saves counting them.
    """
    if metric not in D.METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    q = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("_q"))
    b = base.where(F.col(base_vec).isNotNull()).select(F.col(base_id).alias("base_id"), F.col(base_vec).cast("array<double>").alias("_v"))
    n_q, n_b = max(1, -(-(q.count() if most is None else most) // tile_queries)), max(1, -(-b.count() // tile_rows))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("*", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("_i"), blocks(n_b).alias("_j"))
    b = b.select("*", blocks(n_q).alias("_i"), F.pmod(F.xxhash64("base_id"), F.lit(n_b)).cast("int").alias("_j"))
    kind = {f.name: f.dataType.simpleString() for f in (*q.schema, *b.schema)}
    schema = f"query_id {kind['query_id']}, base_id {kind['base_id']}, _distance double"
    best = q.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(lambda x, y: best_of_tile(x, y, k, metric), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("_distance", "base_id"))
    return best.withColumn("_rank", rank).where(F.col("_rank") <= k)


def move(vector: Column, towards: tuple[Column, float] | None = None, away: tuple[Column, float] | None = None) -> Column:
    if towards:
        vector = D.move_to(vector, *towards)
    if away:
        vector = D.move_away(vector, *away)
    return vector


def multi_target(df: DataFrame, targets: dict[str, tuple[str, list[float]]], k: int, id_col: str, combine: str = "minimum", weights: dict[str, float] | None = None, metric: str = "cosine") -> DataFrame:
    """Hits by several vectors: targets maps a name to (vector column, query). combine: sum, average, minimum, manual, relative.

    A row without one of the vectors is dropped, but for minimum, which uses those it has.
    """
    if combine in ("manual", "relative") and set(weights or ()) != set(targets):
        raise ValueError("a weight is needed for every target")
    names = list(targets)
    df = df.select("*", *(D.distance(metric, F.col(c), D.vector(q)).alias(f"_d_{n}") for n, (c, q) in targets.items()))
    cols = [F.col(f"_d_{n}") for n in names]
    if combine == "minimum":
        total = F.least(*cols) if len(cols) > 1 else cols[0]
        df = df.where(reduce(lambda a, b: a | b, (c.isNotNull() for c in cols)))
    else:
        df = df.dropna(subset=[f"_d_{n}" for n in names])
        if combine == "relative":
            ends = df.agg(*(f(c).alias(f"_{f.__name__}_{n}") for n, c in zip(names, cols, strict=True) for f in (F.min, F.max)))
            df = df.join(F.broadcast(ends), how="cross")  # one row
            share = lambda n: F.when(F.col(f"_max_{n}") > F.col(f"_min_{n}"), (F.col(f"_d_{n}") - F.col(f"_min_{n}")) / (F.col(f"_max_{n}") - F.col(f"_min_{n}"))).otherwise(F.lit(1.0))
            cols = [share(n) for n in names]
        w = weights if combine in ("manual", "relative") else dict.fromkeys(names, 1 / len(names) if combine == "average" else 1.0)
        total = reduce(lambda a, b: a + b, (F.lit(float(w[n])) * c for n, c in zip(names, cols, strict=True)))
    keep = [c for c in df.columns if not c.startswith(("_d_", "_min_", "_max_"))]
    return df.withColumn("_distance", total).select(*keep, "_distance").orderBy("_distance", id_col).limit(k)


def explore(collections: dict[str, tuple[DataFrame, str, str]], query, k: int, metric: str = "cosine", offset: int = 0) -> DataFrame:
    """Hits over several collections: name -> (rows, vector column, id column)."""
    parts = [with_distance(df.where(F.col(v).isNotNull()), v, query, metric).select(F.lit(name).alias("class"), F.col(i).cast("string").alias("id"), "_distance") for name, (df, v, i) in collections.items()]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.orderBy("_distance", "class", "id").offset(offset).limit(k)


def late_interaction(df: DataFrame, vecs: str, query: list[list[float]], k: int, id_col: str, metric: str = "dot") -> DataFrame:
    """Documents of many vectors: for each query vector the nearest of the document's, summed."""
    per = [nearest_in(F.col(vecs), q, metric) for q in query]
    total = reduce(lambda a, b: a + b, per)
    return df.withColumn("_distance", total).where("_distance is not null").orderBy("_distance", id_col).limit(k)


def nearest_in(vecs: Column, query: list[float], metric: str) -> Column:
    return F.array_min(F.transform(vecs, lambda v: D.METRICS[metric](v, D.vector(query))))


def check_indexed(kind: str) -> None:
    """A vector whose index is "skip" is stored but not searched."""
    if kind == "skip":
        raise ValueError("vectors of this collection are stored but not indexed (skip)")
