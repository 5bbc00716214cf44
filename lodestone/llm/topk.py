"""Exact top-k search by inner product over norm-bucketed vectors.

Vectors with equal components are merged first: of each, only the k + 1 smallest ids can reach a result (one may be the
query itself), so a vector repeated over a third of all rows costs no more than another. The rest are grouped into classes of
like length (steps of a factor of 2 ** (1 / 8)), and classes into lanes of bounded size. A tile is a lane with a block of queries.

The queries first meet one lane of the longest class. The k-th best score t of a query there bounds all that follows: classes
that are too short to reach t with it are left out before anything is moved, and in the other tiles t is where pruning
starts. Within a tile buckets come longest first, and t rises. A vector of a bucket must have a cosine of at least
t / (|q| * longest of the bucket). From that local threshold each bucket is pruned one of two ways. By length: where it is low,
vectors of length under t / |q| are skipped. By coordinate: where it is high, the largest coordinates of the query bound those
of a vector that reaches the threshold. Survivors are verified by their full inner products. A second top k per query joins
the tiles.

Null and empty vectors and those with null or non-finite components take no part, nor do those with a component of 2**26 or
more once scaled, whose products may leave 64 bits; vectors of different dimensions do not meet. Products from 2**53 on are
computed as integers. Rows repeated with the same id and vector count once; of an id with several vectors the best counts.
Ties go to the smaller id. Extra columns, whatever their names, are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import written

#: Vectors of a bucket, of a lane, and queries of a block.
BUCKET, LANE, BLOCK = 512, 8192, 1024
#: Local cosine threshold from which coordinates prune better than lengths.
BY_COORDINATE = 0.35
FOCUS = 4


def quantised(c: str, scale: int) -> Column:
    """Components as floor(scale * x); null where the vector takes no part."""
    x = F.col(c).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    return F.when(~bad & ~F.exists(x, lambda v: F.abs(v * scale) >= float(1 << 26)), whole)


def wide_top(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What tile_top gives, by integer products, where doubles would not be exact."""
    found = []
    for q, x in zip(query_ids, queries.astype(np.int64), strict=True):
        other = ids != q
        score, cand = vectors[other].astype(np.int64) @ x, ids[other]
        top = np.lexsort((cand, -score))[:k]
        found.append((np.full(len(top), q), cand[top], score[top]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def tile_top(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec id, score) of each query's k best in a tile. floor: scores of at most that can't reach a query's result."""
    if np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * vectors.shape[1] >= 2.0**53:
        return wide_top(ids, vectors, query_ids, queries, k)
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    length = np.sqrt((vectors * vectors).sum(1))
    order = np.lexsort((ids, -length))
    ids, vectors, length = ids[order], vectors[order], length[order]
    unit = vectors / np.where(length > 0, length, 1)[:, None]
    q_length = np.sqrt((queries * queries).sum(1))
    q_unit = queries / np.where(q_length > 0, q_length, 1)[:, None]
    focus = np.argsort(-np.abs(q_unit), axis=1, kind="stable")[:, :FOCUS]
    best = np.full((len(queries), k), -np.inf)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)

    def merge(rows: np.ndarray, cand: np.ndarray, score: np.ndarray) -> None:
        """Bring candidates (one id a column) into the rows' top k."""
        s, i = np.concatenate((best[rows], score), 1), np.concatenate((best_id[rows], np.broadcast_to(cand, score.shape)), 1)
        if s.shape[1] > 8 * k:
            least = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k]
            most = int((s >= least[:, None]).sum(1).max())  # all ties stay
            top = np.argpartition(-s, most - 1, 1)[:, :most]
            s, i = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        top = np.lexsort((i, -s), axis=1)[:, :k]
        best[rows], best_id[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)

    for at in range(0, len(ids), BUCKET):
        b = slice(at, min(at + BUCKET, len(ids)))
        limit = np.maximum(best[:, -1], floor)
        scale = q_length * length[b.start]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(np.isinf(limit), -1.0, np.where(scale > 0, limit / scale, np.where(limit > 0, 2.0, -1.0))) - 1e-9
        live = local <= 1
        # Length pruning over many queries at once: one product of the whole bucket, cut to the longest that any needs.
        rows = np.flatnonzero(live & (local < BY_COORDINATE))
        if len(rows):
            with np.errstate(divide="ignore", invalid="ignore"):
                shortest = np.where((limit[rows] > 0) & (q_length[rows] > 0), limit[rows] / q_length[rows], 0).min() - 1e-6
            n = int((length[b] >= shortest).sum())
            score = queries[rows] @ vectors[b][:n].T
            score[query_ids[rows][:, None] == ids[b][:n][None, :]] = -np.inf
            merge(rows, ids[b][:n][None, :], score)
        for r in np.flatnonzero(live & (local >= BY_COORDINATE)):
            ok = length[b] * q_length[r] >= limit[r] - 1e-6
            for f in focus[r]:
                t, x = local[r], q_unit[r, f]
                half = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-9
                low, high = x * t - half, x * t + half
                if x >= t:
                    high = 1.0
                if -x >= t:
                    low = -1.0
                ok &= (unit[b, f] >= low - 1e-9) & (unit[b, f] <= high + 1e-9)
            ok &= ids[b] != query_ids[r]
            if ok.any():
                merge(np.array([r]), ids[b][ok][None, :], (vectors[b][ok] @ queries[r])[None, :])
    found = best > -np.inf
    return np.broadcast_to(query_ids[:, None], best.shape)[found], best_id[found], best[found].astype(np.int64)


def tiles(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k best in each tile, (lane, block) of left (vec_id, v) and right (query_id, v, floor)."""

    def tile(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for dim, mine in q.groupby(q.v.map(len)):
            there = a[a.v.map(len) == dim]
            if len(there):
                floor = mine.floor.fillna(-np.inf).to_numpy(np.float64)
                ids, cand, score = tile_top(there.vec_id.to_numpy(), np.stack(there.v.to_list()).astype(np.float64), mine.query_id.to_numpy(), np.stack(mine.v.to_list()).astype(np.float64), k, floor)
                parts.append(pd.DataFrame({"query_id": ids, "vec_id": cand, "score": score}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return left.groupBy("lane", "block").cogroup(right.groupBy("lane", "block")).applyInPandas(tile, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", lane: int = LANE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all vectors but its own id."""
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(embedding, scale).alias("v")).where("v is not null and vec_id is not null and size(v) > 0")
    asked = queries.select(F.col(vec_id).cast("long").alias("query_id"), quantised(embedding, scale).alias("v")).where("v is not null and query_id is not null and size(v) > 0").dropDuplicates()
    # The length of a vector, and its class by the square.
    square = F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x * x)
    own = base.dropDuplicates()
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n")
    own = written(own.withColumn("class", F.floor(F.log2(square + 1) * 4).cast("int")), "vectors")
    asked = written(asked.withColumn("length", F.sqrt(square)), "queries")
    classes = own.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / lane).cast("int").alias("lanes")).orderBy(F.desc("class")).collect()  # some hundred rows
    blocks = max(1, -(-asked.count() // block))
    first = f"{classes[0]['class']}:0" if classes else ""
    n_lanes = F.coalesce(*(F.when(F.col("class") == r["class"], F.lit(r.lanes)) for r in classes), F.lit(1))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # Both sides of a tile are bounded: each vector goes to every block of queries once.
    left = own.select("vec_id", "v", F.concat_ws(":", "class", F.pmod(F.xxhash64("vec_id"), n_lanes)).alias("lane"), spread(F.lit(blocks)).alias("block"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    found = written(tiles(left.where(F.col("lane") == first), asked.select("query_id", "v", "block", F.lit(None).cast("double").alias("floor"), F.lit(first).alias("lane")), k), "first")
    # A query that has k hits of distinct ids in the first lane needs no score under the k-th. Half less keeps ties.
    hits = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    floors = hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") == k).select("query_id", (F.col("score") - 0.5).alias("floor"))
    longest = lambda c: 2.0 ** ((c + 1) / 8)
    every = F.array(*(F.struct(F.lit(r["class"]).alias("class"), F.lit(r.lanes).alias("lanes"), F.lit(longest(r["class"])).alias("longest")) for r in classes)) if classes else F.array().cast("array<struct<class:int,lanes:int,longest:double>>")
    reached = F.filter(every, lambda c: F.col("floor").isNull() | (F.col("length") * c["longest"] >= F.col("floor") - 1))
    right = asked.join(floors, "query_id", "left").select("query_id", "v", "block", "floor", F.explode(reached).alias("c"))
    right = right.select("query_id", "v", "block", "floor", "c.class", spread(F.col("c.lanes")).alias("part"))
    right = right.select("query_id", "v", "block", "floor", F.concat_ws(":", "class", "part").alias("lane")).where(F.col("lane") != first)
    # A vec_id whose rows differ may come up twice; its best row counts.
    found = found.union(tiles(left.where(F.col("lane") != first), right, k)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
