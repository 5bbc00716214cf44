"""Exact top-k search and the n-gram Jaccard join against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lodestone.llm import jaccard, topk
from lodestone.llm.common import components

VEC = "vec_id long, embedding array<float>, query_id string, score string"


def brute_top(rows, asked, k=5):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            ok.setdefault(i, []).append(np.floor(256 * np.asarray(v, np.float32).astype(float)).astype(int))
    out = []
    for q in asked:
        for qv in ok.get(q, [])[:1]:
            best = [(max(int(v @ qv) for v in vs if len(v) == len(qv)), i) for i, vs in ok.items() if i != q and any(len(v) == len(qv) for v in vs)]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("n", "lane", "block"), [(400, 8192, 1024), (700, 64, 4)])
def test_top_k(spark, n, lane, block):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n, 8)) * rng.choice((0.01, 0.3, 2), (n, 1))
    base[n // 3 : n // 2] = base[0]  # one vector repeated by many rows
    base[5] = 0
    rows = [(i, [float(x) for x in v], "a", "b") for i, v in enumerate(base)]
    rows += [(n, None, "a", "b"), (n + 1, [None] * 8, "a", "b"), (n + 2, [float("nan")] * 8, "a", "b"), (None, [1.0] * 8, "a", "b"), (n + 3, [1.0] * 3, "a", "b"), (n + 4, [], "a", "b")]
    rows += rows[7:9]  # repeated rows
    df = spark.createDataFrame(rows, VEC)
    asked = [i for i in range(n + 5) if i % 50 == 0]
    got = topk.search(df, df.where("vec_id % 50 = 0"), lane=lane, block=block).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, asked)


def test_top_k_of_large_products(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-250_000, 250_000, 6)], "a", "b") for i in range(120)] + [(500, [1e9] * 6, "a", "b")]
    df = spark.createDataFrame(rows, VEC)
    got = topk.search(df, df.where("vec_id % 50 = 0"), lane=16, block=2).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows[:-1], [0, 50, 100]) and max(r.score for r in got) > 1 << 50


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], None, None), (1, [0.5, 0.5], None, None)], VEC)
    assert [tuple(r) for r in topk.search(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 128 * 256)]
    none = df.limit(0)
    assert topk.search(none, none).collect() == []


WORDS = [f"w{i}" for i in range(300)]


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.choice((4, 30, 90, 260)))]
        for _ in range(rng.choice((1, 3, 9))):
            w = list(base)
            for _ in range(rng.choice((0, 1, 2, 6))):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            if rng.random() < 0.4:
                w = w[: max(1, int(len(w) * rng.choice((0.95, 0.99))))]
            texts.append(" ".join(w))
            texts.append("\t".join(w).upper()) if rng.random() < 0.2 else None
    texts += [None, "", "  \t ", "one", "One", "one two", "x y z", "Ä b c d", "ä b c d", " ".join(rng.choice(WORDS) for _ in range(20_000))]
    texts += [texts[0]] * 40
    rng.shuffle(texts)
    return [(i, t, "a", 1) for i, t in enumerate(texts)]


def brute_join(rows) -> dict:
    sets = {}
    for i, t, *_ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    low = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = low[a], low[b]
                low = {k: min(x, y) if v in (x, y) else v for k, v in low.items()}
    return {i: (len(s), low[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("seed", "tile"), [(1, 2048), (2, 4), (3, 8)])
def test_jaccard_join(spark, seed, tile):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, keys string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, tile_sets=tile).collect()}
    assert got == brute_join(rows)


def brute_links(rows) -> dict:
    sets = {}
    for i, t, *_ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    return {i: sum(i != j and 100 * len(a & b) >= 90 * len(a | b) for j, b in sets.items()) if a else 0 for i, a in sets.items()}


@pytest.mark.parametrize("tile", [2048, 4])
def test_jaccard_join_counts_every_link(spark, tile):
    rows = corpus(4)
    base = [f"v{i}" for i in range(100)]
    rows += [(10_000 + i, " ".join([*base, *base[:3], f"end{i}"]), "a", 1) for i in range(30)]  # all of them link with all
    df = spark.createDataFrame(rows, "doc_id long, text string, keys string, n int")
    got = {r.doc_id: r.n_links for r in jaccard.join(df, tile_sets=tile).collect()}
    assert got == brute_links(rows) and got[10_000] == 29


def test_jaccard_join_of_nothing_and_repeated_rows(spark):
    kind = "doc_id long, text string"
    assert jaccard.join(spark.createDataFrame([], kind)).collect() == []
    got = jaccard.join(spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (1, "a b c d"), (None, "a b c d")], kind)).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.copy_of) for r in got) == [(0, 1, 1), (1, 1, 1), (3, 1, 1), (3, 1, 1)]
    got = jaccard.join(spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "e f g h"), (7, "i j k l"), (8, "i j k l")], kind)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_links) for r in got) == [(0, 0, 1), (0, 0, 1), (7, 7, 0), (7, 7, 1), (8, 7, 1)]


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100), (76, 100), (60, 100), (1, 1)])
def test_linked_sets_share_a_prefix_key(num, den):
    rng = np.random.default_rng(num)
    linked = 0
    for _ in range(4000):
        a = np.unique(rng.integers(0, 1 << 63, rng.choice([2, 3, 4, 5, 9, 40, 200]), dtype=np.uint64))
        gone, new = rng.integers(0, len(a) // 3 + 2, 2)
        low = rng.random() < 0.5  # differences among the smallest hashes break most keys
        b = np.unique(np.concatenate(((np.sort(a)[gone:] if low else rng.permutation(a)[gone:]), rng.integers(0, 1 << (58 if low else 63), new, dtype=np.uint64))))
        shared = len(np.intersect1d(a, b))
        if len(b) and den * shared >= num * (len(a) + len(b) - shared) and not np.array_equal(a, b):
            linked += 1
            assert len(np.intersect1d(jaccard.prefix_keys(a, num, den), jaccard.prefix_keys(b, num, den)))
    assert linked > 50 or num == den


def test_a_shared_passage_makes_no_candidate_group(spark, monkeypatch):
    rng, real, members = random.Random(6), jaccard.written, []

    def watched(df, name, *rest):
        out = real(df, name, *rest)
        members.extend(out.collect() if name == "member" else [])
        return out

    monkeypatch.setattr(jaccard, "written", watched)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{passage} " + " ".join(str(rng.random()) for _ in range(60))) for i in range(300)]
    rows += [(1000, rows[0][1] + " end"), (1001, passage), (1002, passage + " end")]  # a link, and one within the passage
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert got == {**{i: i for i in range(300)}, 1000: 0, 1001: 1001, 1002: 1001}
    assert len(members) == 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, **{i: 200 for i in (200, 201, 202)}}


def test_small_bitmaps_keep_linked_sets_together():
    rng = np.random.default_rng(9)
    sets = []
    for size in (1, 3, 30, 60, 63, 64, 65, 127, 128, 140, 500, 1030):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        sets += [np.unique(np.concatenate((base[i:], rng.integers(0, 1 << 63, i, dtype=np.uint64)))) for i in (0, 1, max(1, size // 20), size // 8, size // 2)]
    sets = [s for s in sets if len(s)]
    ids, sizes, sides = np.arange(len(sets)), np.array([len(s) for s in sets]), rng.integers(0, 2, len(sets))
    for side in (np.full(len(sets), -1), sides):
        group = list(range(len(sets)))
        for a, b in jaccard.close_in_tile(ids, side, sizes, [jaccard.small_map(s) for s in sets], 80, 100):
            group = [group[a] if g == group[b] else g for g in group]
        linked = 0
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                shared = len(np.intersect1d(a, b))
                if 100 * shared >= 80 * (len(a) + len(b) - shared) and (side[i] < 0 or side[i] != side[j]):
                    linked += 1
                    assert group[i] == group[j]
        assert linked > 10 and len(set(group)) > len(sets) // 5
