"""N-gram Jaccard join: every pair of texts whose word n-gram sets have a Jaccard similarity of at least a threshold.

1. A map makes each text's set of n-grams as sorted 64-bit hashes, a 128-bit digest of the set, and prefix keys. Equal sets
   meet by their digest, and one representative goes on for each.
2. Candidates. Sets are read in one order of all elements, and a key is a pair of neighbours in that order. An element that
   only one of two sets has breaks two pairs of its own set and one of the other's. As links bound how many such elements
   there are, two linked sets share a pair among their first ones, and only those are sent (``prefix_keys``). Chaining the sets
   that share a key gives candidate groups, which contain every linked pair. This is exact in any order, and no key is left out
   for being frequent. The order is that of the hashes, but n-grams which repeat over many texts come last, by their
   counts (``repeated``): so a passage that many texts share makes keys only of texts with little else in them, and groups do not
   grow with the input. Keys that repeat within a batch are chained there and leave it once, so a frequent key's rows are far
   fewer than its texts.
3. Tiles of bitmaps. A candidate group of bounded size is one tile. A larger one is dealt into blocks by size band and hash,
   and tiles are pairs of blocks of equal or adjacent bands, as no others can link. In a tile, hashed bitmaps of one or two
   bits an element bound overlaps from above: each bit that differs means an element that is not shared, so
   overlap <= (a + b - bits that differ) / 2. Edges between sets that pass the bound, only connecting ones, cut the group
   into close groups; linked sets are always in one of these, and texts that merely share a passage seldom are.
4. Tiles of sets, laid over the close groups in the same way. All pairs that pass the bound again, by larger bitmaps, are
   verified by intersecting their sorted sets, so every link is found, each pair in one tile. Each set's number of links,
   weighed by copies, leaves the tile, and of the links themselves only connecting ones, never all pairs of a group.
5. Connected components of the links, copies joined back through their representative.

Nulls, empty texts and texts of blanks have no n-grams (n_shingles 0) and link with nothing. Texts of fewer than n words are
one n-gram. Rows are told apart by id and text: those without an id, or with an id that another text has, are rows of their
own, and repeated rows keep one output row each. Ids of ``component_id`` and ``copy_of`` are null where no row of the
component, or no equal set, has one. Extra columns are ignored, whatever their names. An empty table gives no rows.
Two different n-grams fall together with a chance of 2**-64 a pair, two sets with 2**-128.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, discard, frequent, written
from lodestone.llm.units import held

MIX = np.uint64(0x9E3779B97F4A7C15)
#: A tile's most sets, and most elements over its sets.
TILE_SETS, TILE_ELEMENTS = 2048, 1 << 20
#: Elements that are counted together, and most n-grams of the table that puts frequent ones last.
COUNTED, FREQUENT = 1 << 20, 1 << 16


class Words(dict):
    """Hash of each word's bytes; emptied when large, so that a worker's memory is bounded."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def hashed_grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of so many words, in their order, from the words' hashes."""
    count = max(0, len(h) - size + 1)
    out = h[:count].copy()
    for i in range(1, size):
        out = mixed(out * MIX + h[i : count + i])
    return mixed(out + np.uint64(size))


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of blank-separated words, A-Z lower-cased."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    memory = held("jaccard words", Words)
    h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    return np.unique(hashed_grams(h, min(n, len(words))))


def repeated(texts: DataFrame, n: int) -> DataFrame:
    """(h, c): n-grams that stand more than once in a run of rows, with the sum of these counts. All rows are read.

    It only sets the order in which sets are read, so what a run misses costs time, never a link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(grams), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[c > 1].view(np.int64)), pa.array(c[c > 1])], names=["h", "c"])

        grams, size, memory = [np.empty(0, np.uint64)], 0, held("jaccard words", Words)
        for b in (x.slice(at, 500) for x in batches for at in range(0, x.num_rows, 500)):
            words = [text.lower().split() if text else [] for text in b.column(0).to_pylist()]
            length = np.array([len(x) for x in words])
            h = np.fromiter(map(memory.__getitem__, chain.from_iterable(words)), np.uint64, length.sum())
            left = np.repeat(np.cumsum(length), length) - np.arange(len(h))  # words of the text from here on
            grams.append(hashed_grams(h, n)[left[: max(0, len(h) - n + 1)] >= n])
            size += len(grams[-1])
            if size >= COUNTED:
                yield out()
                grams, size = [np.empty(0, np.uint64)], 0
        yield out()

    return texts.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def rare_first(s: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A sorted set in the order that keys are taken in: elements outside the table (hashes, counts), then those in it by count."""
    h, c = table
    if not len(h) or not len(s):
        return s
    at = np.minimum(np.searchsorted(h, s), len(h) - 1)
    return s[np.argsort(np.where(h[at] == s, c[at], 0), kind="stable")]


def prefix_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys by which a set, its elements in an order that all sets have in common, meets every other one that it links with at num / den.

    Let A of a elements link with B and let A be the one that is looked at. Of A's a - 1 pairs of neighbours, at most
    2 |A - B| + |B - A| are no pairs of B. That is largest where B lies within A, 2 a (1 - num / den). So the first pair that
    both have stands among the first 2 a (1 - num / den) + 1 pairs of either. Above 3 / 4 every set that links with another
    one has so many pairs; below, single elements are the keys, and a shared one is among the first a (1 - num / den) + 1.
    """
    n = len(s)
    if 4 * num > 3 * den:
        return mixed(s[:-1] * MIX + mixed(s[1:]))[: 2 * n * (den - num) // den + 1].view(np.int64)
    return mixed(s[: n * (den - num) // den + 1]).view(np.int64)


def band_edges(num: int, den: int, ratio: float = 1.3) -> list[int]:
    """First sizes of the bands; a set's partners lie in its own band or in one beside it."""
    ratio, edges = max(ratio, 1.05 * den / num), [1]
    while edges[-1] < 1 << 30:
        edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * ratio)))
    return edges


def chained(keys: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each set of a batch, the keys that no earlier one has, and how far before it the sets stand that have the others."""
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    _, first, where = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    earlier = owner[first][where]
    new, links = earlier == owner, np.unique(np.stack((owner, earlier), 1)[owner != earlier], axis=0)
    at = np.cumsum([0, *(len(k) for k in keys)])
    cut = np.searchsorted(links[:, 0], np.arange(len(keys) + 1))
    return [k[new[at[i] : at[i + 1]]] for i, k in enumerate(keys)], [i - links[cut[i] : cut[i + 1], 1] for i in range(len(keys))]


def width(n: int) -> int:
    """64-bit words of a set's small bitmap: one to two bits an element."""
    return 1 << max(1, min(16, n.bit_length()) - 6)


def small_map(s: np.ndarray) -> bytes:
    bits = np.zeros(64 * width(len(s)), bool)
    bits[(mixed(s + MIX) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def close_in_tile(ids: np.ndarray, side: np.ndarray, size: np.ndarray, maps: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Edges that connect the sets of a tile whose small bitmaps allow a link. side as in links_in_tile."""
    order = np.argsort(size, kind="stable")
    ids, side, size, group, out = ids[order], side[order], size[order].astype(np.int64), np.arange(len(ids)), []
    words = np.array([width(int(n)) for n in size])
    # Sets of one width stand together, a word of all of them in a row. A set meets those of its own width and, folded, those
    # of smaller ones.
    maps = {int(w): np.ascontiguousarray(np.frombuffer(b"".join(maps[i] for i in order[words == w]), np.uint64).reshape(-1, w).T) for w in np.unique(words)}
    start = {w: int(np.searchsorted(words, w)) for w in maps}
    for i in range(1, len(ids)):
        first, fold = int(np.searchsorted(size, -(-int(size[i]) * num // den))), maps[int(words[i])][:, i - start[int(words[i])]]
        parts = []
        for w in sorted(maps, reverse=True):
            low, high = max(first, start[w]), min(i, start[w] + maps[w].shape[1])
            if w > words[i] or low >= high:
                continue
            while len(fold) > w:
                fold = fold[: len(fold) // 2] | fold[len(fold) // 2 :]
            there, apart = maps[w][:, low - start[w] : high - start[w]], np.zeros(high - low, np.int32)
            for mine, theirs in zip(fold, there, strict=True):
                apart += np.bitwise_count(theirs ^ mine)
            most = (size[low:high] + size[i] - apart) // 2
            parts.append(low + np.flatnonzero(den * most >= num * (size[low:high] + size[i] - most)))
        part = np.concatenate(parts) if parts else np.zeros(0, int)
        for j in part[((side[part] < 0) | (side[part] != side[i])) & (group[part] != group[i])]:
            if group[j] != group[i]:
                out.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return out


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set; bits chosen by hash, at least four for each element of the largest set."""
    bits = max(256, 1 << int(4 * max(map(len, sets)) - 1).bit_length())
    bits = min(bits, 1 << 16)
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, s in zip(out, sets, strict=True):
        h = mixed(s + MIX) & np.uint64(bits - 1)
        np.bitwise_or.at(row, (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return out


def links_in_tile(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], times: np.ndarray, num: int, den: int) -> list[tuple[int, int, int]]:
    """(a, b, 0) for links that connect what this tile connects, (a, a, n) for the n rows that a is linked with in this tile.

    side: -1 pairs with all, else only with the other side. times: how many rows have the set.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, side, times, sets = ids[order], side[order], times[order], [sets[i] for i in order]
    size, maps, group, out = np.array([len(s) for s in sets], np.int64), bitmaps(sets), np.arange(len(sets)), []
    distinct, number = np.unique(np.concatenate(sets), return_inverse=True)
    start, here, degree = np.cumsum(size) - size, np.zeros(len(distinct), bool), np.zeros(len(sets), np.int64)
    for i in range(1, len(sets)):
        first = int(np.searchsorted(size, -(-int(size[i]) * num // den)))
        if first >= i:
            continue
        near = np.flatnonzero((side[first:i] < 0) | (side[first:i] != side[i])) + first
        mine = number[start[i] : start[i] + size[i]]
        here[mine] = True
        for part in np.array_split(near, max(1, len(near) * maps.shape[1] >> 20)):
            apart = np.bitwise_count(maps[part] ^ maps[i]).sum(1, dtype=np.int64)
            most = (size[part] + size[i] - apart) // 2
            part = part[den * most >= num * (size[part] + size[i] - most)]
            if not len(part):
                continue
            n = size[part]
            at = np.cumsum(n) - n
            both = np.add.reduceat(here[number[np.repeat(start[part] - at, n) + np.arange(n.sum())]], at, dtype=np.int64)
            part = part[den * both >= num * (n + size[i] - both)]
            degree[i] += times[part].sum()
            degree[part] += times[i]
            for j in part[np.unique(group[part], return_index=True)[1]]:
                if group[j] != group[i]:
                    out.append((int(ids[i]), int(ids[j]), 0))
                    group[group == group[j]] = group[i]
        here[mine] = False
    linked = np.flatnonzero(degree)
    return out + list(zip(ids[linked].tolist(), ids[linked].tolist(), degree[linked].tolist(), strict=True))


#: What tells rows apart: rows that agree in all three repeat one id and one text.
IDENTITY = ["_row_no_id", "_row_id", "_row_text"]


def identified(docs: DataFrame) -> DataFrame:
    """docs with the columns of IDENTITY: whether the row has no id, the id or 0, and a hash of the text."""
    return docs.withColumns({"_row_no_id": F.col("doc_id").isNull(), "_row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_row_text": F.xxhash64(F.col("text").cast("binary"))})


def join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, tile_sets: int = TILE_SETS, tile_elements: int = TILE_ELEMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id, copy_of and n_links of every row of doc_id, text.

    copy_of is the smallest id with an equal set, n_links the number of other rows that the row is linked with.
    """
    return rows(docs, n, num, den, tile_sets, tile_elements).drop(*IDENTITY, "is_first")


def tiled(member: DataFrame, num: int, den: int, tile_sets: int, tile_elements: int) -> DataFrame:
    """(comp, node, low, high, i, j, side): the tiles of every member (comp, node, n) of a group. Two members of one group whose
    sizes allow a link meet in one tile: within it if side is -1, else only if their sides differ."""
    edges = F.array(*(F.lit(x) for x in band_edges(num, den)))
    count = (F.ceil(F.count(F.lit(1)) / tile_sets), F.ceil(F.sum("n") / tile_elements))
    tiles = member.groupBy("comp").agg(F.greatest(*count).cast("int").alias("tiles"))
    member = member.join(tiles, "comp").withColumn("band", F.when(F.col("tiles") > 1, F.size(F.filter(edges, lambda x: x <= F.col("n")))).otherwise(0))
    # Blocks hold half a tile, as a tile is two of them.
    blocks = member.groupBy("comp", "band").agg(F.greatest(F.lit(1), *(F.when(F.max("tiles") > 1, 2 * c).otherwise(1) for c in count)).cast("int").alias("blocks"))
    beside = blocks.select("comp", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = blocks.select("comp", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    member = member.join(blocks, ["comp", "band"]).join(beside, ["comp", "band"], "left").join(below, ["comp", "band"], "left")
    member = member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.col("band").alias("low"), F.col("band").alias("high"), F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), F.when(j == F.col("block"), -1).when(F.col("block") < j, 0).otherwise(1).alias("side")))
    up = F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda j: F.struct(F.col("band").alias("low"), (F.col("band") + 1).alias("high"), F.col("block").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    down = F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda j: F.struct((F.col("band") - 1).alias("low"), F.col("band").alias("high"), j.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")))
    none = F.array().cast("array<struct<low:int,high:int,i:int,j:int,side:int>>")
    # Two blocks of one band need their within-block tile once only; it is the tile (i, i).
    return member.select("comp", "node", F.explode(F.concat(own, F.coalesce(up, none), F.coalesce(down, none))).alias("t")).select("comp", "node", "t.*")


def rows(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, tile_sets: int = TILE_SETS, tile_elements: int = TILE_ELEMENTS) -> DataFrame:
    """What join gives, with the columns of IDENTITY and is_first: the row is the smallest of its component by IDENTITY."""
    source = identified(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))).select(*IDENTITY, "text")

    spark = docs.sparkSession
    often = frequent(written(repeated(source, n), "repeated"), FREQUENT).toPandas().sort_values("h", key=lambda h: h.to_numpy(np.int64).view(np.uint64))
    often = spark.sparkContext.broadcast((often.h.to_numpy(np.int64).view(np.uint64), often.c.to_numpy(np.int64)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, 1000) for x in batches for at in range(0, x.num_rows, 1000)):
            size, high, low, maps, keys = [], [], [], [], []
            for text in b.column(3).to_pylist():
                s = shingles(text, n)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                size.append(len(s))
                high.append((d >> 64) - (1 << 63))
                low.append((d & (1 << 64) - 1) - (1 << 63))
                maps.append(small_map(s))
                keys.append(prefix_keys(rare_first(s, often.value), num, den))
            new, before = chained(keys)
            cols = [*(pa.array(x, pa.int64()) for x in (size, high, low)), pa.array(maps, pa.binary()), pa.array(new, pa.list_(pa.int64())), pa.array(before, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], names=[*IDENTITY, "n", "h1", "h2", "map", "keys", "before"])

    schema = "_row_no_id boolean, _row_id long, _row_text long, n long, h1 long, h2 long, map binary, keys array<long>, before array<int>"
    # Numbers are consecutive within a task's rows, and a batch is a run of these.
    whole = written(source.mapInArrow(keyed, schema).withColumn("uid", F.monotonically_increasing_id()), "keys")
    sets = written(whole.drop("keys", "before", "map"), "sets")
    shared = whole.select("uid", F.explode("keys").alias("key"))
    across = shared.select("uid", F.expr("lag(uid) over (partition by key order by uid)").alias("before")).where("before is not null and before <> uid")
    loose = components(across.union(whole.select("uid", F.explode(F.transform("before", lambda x: F.col("uid") - x)).alias("before"))), "uid", "before")

    copies = whole.groupBy("h1", "h2", "n").agg(F.min(F.struct(*IDENTITY, F.col("uid").alias("rep"))).alias("x"), F.count(F.lit(1)).alias("times"), F.first("map").alias("map"))
    copies = written(copies.select("h1", "h2", "n", "times", "map", "x.*"), "copies")
    discard(whole)
    # Equal sets have all keys in common, so they are in one group.
    digests = loose.join(sets.select(F.col("uid").alias("node"), "h1", "h2", "n"), "node").groupBy("h1", "h2", "n").agg(F.min("comp").alias("comp"))
    member = written(digests.join(copies, ["h1", "h2", "n"]).select("comp", F.col("rep").alias("node"), "n"), "member")

    def near(t: pa.Table) -> pa.Table:
        found = close_in_tile(*(t.column(c).to_numpy() for c in ("node", "side", "n")), t.column("map").to_pylist(), num, den)
        return pa.table([pa.array(x) for x in np.array(found, np.int64).reshape(-1, 2).T.copy()], names=["a", "b"])

    placed = tiled(member, num, den, 4 * tile_sets, 8 * tile_elements)  # maps are that much smaller
    maps = member.select("node").join(copies.select(F.col("rep").alias("node"), "n", "map"), "node")
    close = components(placed.join(maps, "node").groupBy("comp", "low", "high", "i", "j").applyInArrow(near, "a long, b long"))
    asked = written(close.join(copies.select(F.col("rep").alias("node"), "n", "times", *IDENTITY), "node"), "asked")
    placed = tiled(asked.select("comp", "node", "n"), num, den, tile_sets, tile_elements).join(asked.select("node", "times"), "node")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, n).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "members"])

    # Few texts are asked for. Where the list of their hashes is small by its file, Spark broadcasts it, and no other text is moved.
    there = source.join(asked.select("_row_text"), "_row_text", "left_semi")
    needed = there.join(asked.select("node", *IDENTITY), IDENTITY).select("node", "text").mapInArrow(rebuilt, "node long, members binary")
    needed = needed.groupBy("node").agg(F.first("members").alias("members"))  # repeated rows

    def tile(t: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in t.column("members").to_pylist()]
        found = links_in_tile(t.column("node").to_numpy(), t.column("side").to_numpy(), sets, t.column("times").to_numpy(), num, den)
        return pa.table([pa.array(x) for x in np.array(found, np.int64).reshape(-1, 3).T.copy()], names=["a", "b", "links"])

    links = written(placed.join(needed, "node").groupBy("comp", "low", "high", "i", "j").applyInArrow(tile, "a long, b long, links long"), "links")
    linked = components(links.where("a <> b")).withColumnRenamed("node", "rep")
    degree = links.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    firsts = linked.join(copies, "rep").groupBy("comp").agg(F.min(F.struct(*IDENTITY)).alias("first"))
    reps = copies.select("h1", "h2", F.struct(*IDENTITY).alias("copy"), "times", "rep").join(linked.join(firsts, "comp").select("rep", "first"), "rep", "left").join(degree, "rep", "left")
    out = sets.select(*IDENTITY, "n", "h1", "h2").join(reps, ["h1", "h2"])
    own = F.struct(*IDENTITY)
    first = F.when(F.col("n") == 0, own).otherwise(F.coalesce("first", "copy"))
    copy = F.when(F.col("n") == 0, own).otherwise(F.col("copy"))
    n_links = F.when(F.col("n") == 0, 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("times") - 1).cast("long")
    id_of = lambda x: F.when(~x["_row_no_id"], x["_row_id"])
    return out.select(*IDENTITY, id_of(own).alias("doc_id"), F.col("n").alias("n_shingles"), id_of(first).alias("component_id"), id_of(copy).alias("copy_of"), n_links.alias("n_links"), (own == first).alias("is_first"))
