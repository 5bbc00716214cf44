"""Approximate search over an inverted file: vectors are posted under their nearest centroids, queries probe some of them.

An index is built once and written, partitioned by list; searches read the lists that they probe and no others, for many
queries at once. Centroids are fitted on a bounded sample; every row is posted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.vector import TILE_ROWS, best_of_tile, knn, least_cosine, still_near, with_distance

#: Rows up to which search is exact.
FLAT_UNTIL = 10_000
#: Rows to which centroids are fitted, chosen by a hash of the id.
FIT_ROWS = 20_000


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fitted_centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k-means of a bounded sample: distinct rows as seeds, then Lloyd's rounds; an empty cluster keeps its centroid."""
    if not len(x):
        return np.zeros((k, 0))
    rng = np.random.default_rng(seed)
    seeds = [int(rng.integers(len(x)))]
    far = ((x - x[seeds[0]]) ** 2).sum(1)
    while len(seeds) < k:  # by squared distance from those chosen before
        p = far / far.sum() if far.sum() > 0 else np.full(len(x), 1 / len(x))
        seeds.append(int(rng.choice(len(x), p=p)))
        far = np.minimum(far, ((x - x[seeds[-1]]) ** 2).sum(1))
    c = x[seeds]
    for _ in range(rounds):
        near = (-2 * x @ c.T + (c**2).sum(1)).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class InvertedFile:
    """postings: every row once for each of its ``replicas`` centroids, in a column ``_list``, with its cosine to that one in
    ``_turn`` and whether that is its nearest in ``_first``. centroids: a bounded table."""

    postings: DataFrame
    centroids: np.ndarray
    vec: str
    id_col: str

    def write(self, path: str) -> InvertedFile:
        """Keep the index in a folder that all executors share, one partition for each list."""
        spark = self.postings.sparkSession
        self.postings.repartition("_list", F.pmod(F.xxhash64(self.id_col), F.lit(16))).write.partitionBy("_list").parquet(f"{path}/postings")
        head = json.dumps({"centroids": self.centroids.tolist(), "vec": self.vec, "id": self.id_col})
        spark.createDataFrame([(head,)], "head string").coalesce(1).write.parquet(f"{path}/head")
        return open_index(spark, path)

    def probed(self, x: np.ndarray, probes: int, max_ratio: float) -> list[list[int]]:
        """Lists to probe for each query: the nearest ones, but for those too far beyond the nearest."""
        d = ((unit(x)[:, None] - self.centroids[None]) ** 2).sum(2)
        near = np.argsort(d, axis=1, kind="stable")[:, :probes]
        return [[int(i) for i in row if d[n, i] <= max(d[n, row[0]], 1e-12) * max_ratio] for n, row in enumerate(near)]

    def search(self, query: list[float], k: int, probes: int = 8, max_ratio: float = 10.0, metric: str = "cosine", exact: bool = False) -> DataFrame:
        """The k nearest of what the probed lists hold, scored exactly.

        exact: the k nearest of all rows. Of the other lists those rows are scored, too, which by their angle to the list's
        centroid can be as near as the k-th found.
        """
        if exact and metric != "cosine":
            raise ValueError("bounds are known for the cosine distance only")
        lists = self.probed(np.asarray([query], float), probes, max_ratio)[0]
        hits = with_distance(self.postings.where(F.col("_list").isin(lists)), self.vec, query, metric).drop("_list", "_turn", "_first")
        best = hits.orderBy("_distance", self.id_col).limit(k * len(lists))  # an id stands in each of them once at most
        best = best.dropDuplicates([self.id_col]).orderBy("_distance", self.id_col).limit(k)
        if not exact:
            return best
        cosines = F.lit((unit(self.centroids) @ unit(np.asarray([query], float))[0]).tolist())
        once = self.postings.where("_first")
        near = still_near(once, least_cosine(F.get(cosines, F.col("_list")), F.col("_turn")), best, k)
        return with_distance(near, self.vec, query, metric).drop("_list", "_turn", "_first").orderBy("_distance", self.id_col).limit(k)

    def search_many(self, queries: DataFrame, query_id: str, query_vec: str, k: int, probes: int = 8, max_ratio: float = 10.0, metric: str = "cosine") -> DataFrame:
        """(query_id, base_id, _distance, _rank) for a table of queries: a tile is a list's part and the queries that probe it."""
        kind = queries.schema[query_id].dataType.simpleString()
        index = InvertedFile(None, self.centroids, self.vec, self.id_col)  # without the rows, to send to tasks

        def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    yield f.assign(_list=index.probed(np.stack(f._q.to_list()).astype(float), probes, max_ratio))

        q = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("_q"))
        q = q.mapInPandas(probe, f"query_id {kind}, _q array<double>, _list array<int>").withColumn("_list", F.explode("_list"))
        b = self.postings.select(F.col(self.id_col).alias("base_id"), F.col(self.vec).cast("array<double>").alias("_v"), F.col("_list").cast("int").alias("_list"))
        # Long lists are cut into parts by a hash; short queries' sides go to every part.
        parts = b.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("_parts"))  # a row for each list
        b = b.join(F.broadcast(parts), "_list").select("base_id", "_v", "_list", F.pmod(F.xxhash64("base_id"), F.col("_parts")).cast("int").alias("_part"))
        q = q.join(F.broadcast(parts), "_list").select("query_id", "_q", "_list", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
        schema = f"query_id {kind}, base_id {self.postings.schema[self.id_col].dataType.simpleString()}, _distance double"
        best = q.groupBy("_list", "_part").cogroup(b.groupBy("_list", "_part")).applyInPandas(lambda x, y: best_of_tile(x, y, k, metric), schema)
        best = best.groupBy("query_id", "base_id").agg(F.min("_distance").alias("_distance"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("_distance", "base_id"))
        return best.withColumn("_rank", rank).where(F.col("_rank") <= k)


def build(df: DataFrame, vec: str, id_col: str, lists: int = 32, replicas: int = 2, fit_rows: int = FIT_ROWS, seed: int = 7) -> InvertedFile:
    """Centroids by k-means on the fit_rows rows of smallest hash; every row with a vector is posted."""
    have = df.where(F.col(vec).isNotNull())
    sample = have.select(F.col(vec).alias("_v")).orderBy(F.xxhash64(id_col), id_col).limit(fit_rows).toPandas()._v
    centers = fitted_centroids(unit(np.stack(sample.to_list()).astype(float)) if len(sample) else np.zeros((0, 1)), lists, seed=seed)

    def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = unit(np.stack(f[vec].to_list()).astype(float))
                near = np.argsort(-2 * x @ centers.T + (centers**2).sum(1), axis=1, kind="stable")[:, :replicas]
                turn = np.einsum("nd,nrd->nr", x, unit(centers)[near])
                yield f.assign(_list=near.astype(np.int32).tolist(), _turn=turn.tolist())

    posted = have.mapInPandas(post, T.StructType([*df.schema, T.StructField("_list", T.ArrayType(T.IntegerType())), T.StructField("_turn", T.ArrayType(T.DoubleType()))]))
    each = posted.select(*df.columns, F.posexplode(F.arrays_zip("_list", "_turn")).alias("_pos", "_at"))
    return InvertedFile(each.select(*df.columns, F.col("_at._list").alias("_list"), F.col("_at._turn").alias("_turn"), (F.col("_pos") == 0).alias("_first")), centers, vec, id_col)


def open_index(spark: SparkSession, path: str) -> InvertedFile:
    """An index that was written."""
    head = json.loads(spark.read.parquet(f"{path}/head").first().head)
    return InvertedFile(spark.read.parquet(f"{path}/postings"), np.asarray(head["centroids"]), head["vec"], head["id"])


def dynamic(df: DataFrame, vec: str, id_col: str, query: list[float], k: int, flat_until: int = FLAT_UNTIL, probes: int = 8, exact: bool = False, **index) -> DataFrame:
    """Exact while the collection is small, by an inverted file beyond (with ``exact``, completed by its bounds). Only whether there are more rows than that is asked."""
    if df.select(F.lit(1)).limit(flat_until + 1).count() <= flat_until:
        return knn(df, vec, query, k, id_col)
    return build(df, vec, id_col, **index).search(query, k, probes, exact=exact)
