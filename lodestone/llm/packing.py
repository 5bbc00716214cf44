"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens (only longer ones are cut; their first piece may be shorter). Full
pieces are sequences by themselves. The others are dealt by a hash into blocks of about ``block`` pieces; each block is
evolved by several islands from different seeds. An individual is a list of bins. Crossover injects whole well-filled bins
of one parent into the other, removes the other's bins that hold duplicates and best-fits the displaced pieces,
longest first. After each epoch every island's best individual moves to the next island of its block, and at the end the
block's best is kept. Only lengths and piece numbers are shuffled, never texts or ids.

Null and empty texts are one end token. Repeated rows are packed each. Ties go to the lower bin. Extra columns of the input
are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written
from lodestone.llm.units import library_ids

END = 0
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes what does not fill a sequence."""
    first = n % capacity or capacity if n > capacity else n
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int) -> DataFrame:
    """Every document's pieces with the checksums of their ids; a map over rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = library_ids(path, pattern), struct.pack("<I", END)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = b"".join(encode(text)) + end if text else end
                rows += [(doc, i, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])) for i, (at, n) in enumerate(cut(len(ids) // 4, capacity))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], names=[x.split()[0] for x in PIECE_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE_SCHEMA)


def best_fit(items: list[int], size: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put items, in their order, into the bin that leaves least room, or into a new one."""
    by_room = sorted((r, i) for i, r in enumerate(room) if r > 0)
    for x in items:
        n = size[x]
        at = bisect_left(by_room, (n, -1))
        if at < len(by_room):
            r, i = by_room.pop(at)
            bins[i].append(x)
        else:
            r, i = capacity, len(bins)
            bins.append([x])
            room.append(capacity)
        room[i] = r - n
        if room[i] > 0:
            insort(by_room, (room[i], i))


def fitness(room: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals the uneven filling that leaves bins to spare later."""
    return -len(room), float(np.square(1 - np.asarray(room) / capacity).sum())


def cross(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: random.Random) -> tuple[list[list[int]], list[int]]:
    """Bins of b that are filled well, those of a that are free of their pieces, the rest placed by best fit."""
    full = [(capacity - sum(size[x] for x in g), g) for g in b]
    limit = rng.choice((0, capacity // 512, capacity // 128))
    injected = [g for r, g in full if r <= limit and rng.random() < 0.7]
    taken = {x for g in injected for x in g}
    kept = [g for g in a if taken.isdisjoint(g)]
    # The emptiest of the kept bins are opened too, else their room is never filled.
    kept.sort(key=lambda g: sum(size[x] for x in g), reverse=True)
    opened = kept[len(kept) - len(kept) // 8 :]
    kept = kept[: len(kept) - len(opened)]
    there = taken.union(*kept) if kept else taken
    bins = [list(g) for g in injected + kept]
    room = [capacity - sum(size[x] for x in g) for g in bins]
    loose = sorted((x for g in a for x in g if x not in there), key=lambda x: (-size[x], x))
    best_fit(loose, size, bins, room, capacity)
    return bins, room


def grouped(solution: np.ndarray) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(int(solution.max()) + 1)] if len(solution) else []
    for x, g in enumerate(solution):
        bins[g].append(x)
    return bins


def evolve(size: list[int], start: list[np.ndarray], capacity: int, generations: int, population: int, seed: int) -> np.ndarray:
    """The best individual after some generations, as the bin of every piece; start: individuals that came from before."""
    rng = random.Random(seed)
    pop = []
    for solution in start:
        bins = grouped(solution)
        pop.append((fitness(room := [capacity - sum(size[x] for x in g) for g in bins], capacity), bins, room))
    while len(pop) < population:
        noise = 0.0 if not pop else rng.choice((0.02, 0.1, 0.3))
        order = sorted(range(len(size)), key=lambda x: (-size[x] * (1 + noise * rng.random()), x))
        bins, room = [], []
        best_fit(order, size, bins, room, capacity)
        pop.append((fitness(room, capacity), bins, room))
    for _ in range(generations):
        a, b = rng.sample(pop, 2)
        bins, room = cross(a[1], b[1], size, capacity, rng)
        pop.append((fitness(room, capacity), bins, room))
        pop.remove(min(pop, key=lambda p: p[0]))
    out = np.zeros(len(size), np.int32)
    for g, members in enumerate(max(pop, key=lambda p: p[0])[1]):
        out[members] = g
    return out


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, block: int = 4096, islands: int = 2, epochs: int = 2, generations: int = 6, population: int = 4) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    table = written(pieces(docs, path, pattern, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    loose = table.where(F.col("length") < capacity)
    n_blocks = max(1, -(-loose.count() // block))
    # A block's size is that of a hash bucket, about `block`, whatever the corpus holds.
    state = loose.groupBy(F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("uid", F.col("length").cast("int").alias("length")))).alias("items"))
    state = state.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.uid").alias("uids"), F.col("items.length").alias("sizes"), F.array().cast("array<array<int>>").alias("best"))
    schema = "block long, island int, uids array<long>, sizes array<int>, best array<array<int>>, bins int"

    def run(frames: Iterator[pd.DataFrame], epoch: int) -> Iterator[pd.DataFrame]:
        for f in frames:
            best = [evolve(list(map(int, s)), [np.asarray(x) for x in b], capacity, generations, population, hash((int(k), int(i), epoch))) for k, i, s, b in zip(f.block, f.island, f.sizes, f.best, strict=True)]
            yield f.assign(best=[[b] for b in best], bins=[int(b.max()) + 1 if len(b) else 0 for b in best])[["block", "island", "uids", "sizes", "best", "bins"]]

    for epoch in range(epochs):
        evolved = written(state.repartition("block", "island").mapInPandas(lambda frames, e=epoch: run(frames, e), schema), "islands")
        moved = evolved.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("best").alias("came"))
        state = evolved.join(moved, ["block", "island"]).select("block", "island", "uids", "sizes", F.concat("best", "came").alias("best"))
    best = evolved.groupBy("block").agg(F.min_by(F.struct("uids", "sizes", F.col("best")[0].alias("bin")), F.struct("bins", "island")).alias("x")).select("block", "x.*")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, uids, sizes, bins in zip(f.block, f.uids, f.sizes, f.bin, strict=True):
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(np.asarray(sizes)[order])
                first = np.searchsorted(np.asarray(bins)[order], np.asarray(bins)[order])
                offset = ends - np.asarray(sizes)[order]
                yield pd.DataFrame({"uid": np.asarray(uids)[order], "sequence_id": (int(k) << 24) + np.asarray(bins)[order].astype(np.int64), "offset": offset - offset[first]})

    placed = best.select("block", "uids", "sizes", "bin").mapInPandas(place, "uid long, sequence_id long, offset long")
    names = [*(x.split()[0] for x in PIECE_SCHEMA.split(", ")), "sequence_id", "offset"]
    full = table.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    return table.join(placed, "uid").select(names).unionByName(full.select(names))
