"""Operators against plain versions in Python, where SQL can't say what they do; recall; near ties."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ann, classify, hybrid, keyword, mutate, post, quantize, vector
from lodestone.operators.filters import Ref, points_to, prop, where
from lodestone.plans.query import Hybrid, NearText, Searchable
from lodestone.sources.collection import Collection, Property, inferred, validated
from lodestone.streaming import ingest


def cos(a, b) -> float:
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return max(0.0, 1 - (float(np.dot(a, b)) / n if n else 0.0))


def test_nothing_is_ranked_by_rounded_distances(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0004]), (2, [1.0, 0.0001]), (3, [0.0, 1.0]), (4, None)], "id int, v array<double>")
    assert [r.id for r in vector.knn(df, "v", [1.0, 0.0], 1, "id").collect()] == [2]
    q = spark.createDataFrame([(9, [1.0, 0.0])], "id int, v array<double>")
    assert [r.base_id for r in vector.nearest_of_each(q, df, 2, "id", "id", "v", "v").orderBy("_rank").collect()] == [2, 1]
    both = df.withColumn("w", F.col("v"))
    assert [r.id for r in vector.multi_target(both, {"a": ("v", [1.0, 0.0]), "b": ("w", [1.0, 0.0])}, 1, "id", "sum").collect()] == [2]


def test_fused_scores_are_ranked_by_seven_digits(spark):
    hits = lambda *rows: spark.createDataFrame(rows, "id int, score double")
    near = spark.createDataFrame([(1, 0.5000004), (2, 0.5), (3, 0.9)], "id int, _distance double")
    out = hybrid.hybrid(hits((1, 1.0), (2, 1.0)), near, "id", alpha=0.75, fusion="relative").collect()
    assert [r.id for r in out] == [2, 1, 3]  # they differ in the seventh digit
    out = hybrid.ranked([("keyword", hits((1, 2.0), (2, 1.0)), 0.5), ("vector", hits((2, 2.0), (1, 1.0)), 0.5)], "id").collect()
    assert [r.id for r in out] == [2, 1]  # equal sums and raw scores: the larger id


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2-squared", "manhattan", "hamming"])
def test_nearest_of_each_in_tiles(spark, metric):
    rng = np.random.default_rng(3)
    base = rng.integers(-3, 4, (90, 5)).astype(float)
    base[40:60] = base[3]  # ties
    ask = np.concatenate((base[:7], rng.normal(size=(6, 5))))
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)] + [(900, None)], "id long, v array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(ask)] + [(901, None)], "id long, v array<double>")
    got = vector.nearest_of_each(q, b, 4, "id", "id", "v", "v", metric, tile_queries=4, tile_rows=11).collect()
    far = {"cosine": lambda x, y: round(cos(x, y), 12), "dot": lambda x, y: round(-float(x @ y), 12), "l2-squared": lambda x, y: float(((x - y) ** 2).sum()), "manhattan": lambda x, y: float(np.abs(x - y).sum()), "hamming": lambda x, y: float((x != y).sum())}[metric]
    want = {(i, n, r + 1) for i, x in enumerate(ask) for r, (_, n) in enumerate(sorted((far(x, y), n) for n, y in enumerate(base))[:4])}
    assert {(r.query_id, r.base_id, r._rank) for r in got} == want


def clustered(spark, n: int = 3000, dims: int = 24, seed: int = 5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, dims))[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, dims))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def recall_of(found: dict[int, list], x: np.ndarray, asked: list[int], k: int = 10) -> float:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = np.argsort(1 - unit[asked] @ unit.T, axis=1, kind="stable")[:, :k]
    return float(np.mean([len(set(b.tolist()) & set(found[i])) / k for i, b in zip(asked, best, strict=True)]))


def test_recall_of_a_kept_inverted_file(spark, tmp_path):
    x, df = clustered(spark)
    kept = ann.build(df, "v", "id", lists=24, replicas=2).write(f"file://{tmp_path}/index")
    asked = list(range(0, 3000, 100))
    found: dict[int, list] = {i: [] for i in asked}
    for r in kept.search_many(df.where("id % 100 = 0"), "id", "v", 10, probes=8).collect():
        found[r.query_id].append(r.base_id)
    assert recall_of(found, x, asked) >= 0.9
    again = ann.open_index(spark, f"file://{tmp_path}/index")
    one = [r.id for r in again.search(x[100].tolist(), 10, probes=8).collect()]
    assert one == sorted(found[100], key=lambda i: (round(cos(x[100], x[i]), 12), i)) and one[0] == 100
    plan = again.postings.where(F.col("_list").isin(1, 2))._jdf.queryExecution().toString()
    assert "PartitionFilters: [_list" in plan
    assert {r.id for r in again.postings.select("id").distinct().collect()} == set(range(3000))


def test_recall_of_codes(spark):
    x, df = clustered(spark)
    asked = list(range(0, 3000, 500))
    books = quantize.product_quantizer(df, "v", 6, 32)
    product, turned, signs = quantize.product_codes(df, "v", books).cache(), quantize.rotational_codes(df, "v").cache(), quantize.rotational_codes(df, "v", bits=1).cache()
    ways = {
        "product": lambda q: quantize.rescored(product, quantize.product_distance("_pq", books, q), "v", q, 10, 300, "id"),
        "rotational": lambda q: quantize.rescored(turned, quantize.rotational_distance(q), "v", q, 10, quantize.RESCORE["rq"], "id"),
        "one bit": lambda q: quantize.rescored(signs, quantize.rotational_distance(q), "v", q, 10, quantize.RESCORE["brq"], "id"),
    }
    for name, search in ways.items():
        found = {i: [r.id for r in search(x[i].tolist()).collect()] for i in asked}
        assert recall_of(found, x, asked) >= 0.9, name


def test_fast_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(20, 48))
    y = quantize.rotated(x)
    assert y.shape == (20, 64) and np.allclose(x @ x.T, y @ y.T) and np.allclose(quantize.rotated(x[:3]), y[:3])


def test_recall_of_fixed_dimensional_encodings(spark):
    rng = np.random.default_rng(2)
    themes = rng.normal(size=(30, 12))
    docs = [themes[rng.integers(0, 30, 2)][rng.integers(0, 2, 6)] + 0.3 * rng.normal(size=(6, 12)) for _ in range(600)]
    df = spark.createDataFrame([(i, d.tolist()) for i, d in enumerate(docs)] + [(999, [])], "id long, t array<array<double>>")
    score = []
    for i in range(0, 600, 120):
        q = docs[i][:4].tolist()
        best = sorted(range(600), key=lambda n: (sum(min(-float(np.dot(t, v)) for t in docs[n]) for v in q), n))[:10]
        found = [r.id for r in quantize.muvera_search(df, "t", q, 10, "id", rescore=120, projected=8, repetitions=8).collect()]
        score.append(len(set(best) & set(found)) / 10)
    assert np.mean(score) >= 0.9


def test_kmeans_against_numpy(spark):
    x, df = clustered(spark, 400, 6)
    c = x[:5].copy()
    for _ in range(3):
        mine = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.stack([x[mine == i].mean(0) if (mine == i).any() else c[i] for i in range(5)])
    rows, got = quantize.kmeans(df, "v", x[:5], rounds=3)
    assert np.allclose(got, c)
    want = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert {r.id: r._cluster for r in rows.collect()} == dict(enumerate(want.tolist()))


def test_semantic_groups_and_projection(spark):
    x, df = clustered(spark, 60, 8)
    hits = vector.knn(df, "v", x[0].tolist(), 40, "id")
    rows = sorted(hits.collect(), key=lambda r: (r._distance, r.id))
    want: list[int] = []
    for i, r in enumerate(rows):
        near = [want[j] for j in range(i) if (1 - float(np.dot(r.v, rows[j].v)) / (np.linalg.norm(r.v) * np.linalg.norm(rows[j].v))) / 2 < 0.2]
        want.append(min(near) if near else max(want, default=-1) + 1)
    got = {r.id: r._group for r in post.semantic_groups(hits, "v", ["_distance", "id"], 0.2).collect()}
    assert got == {r.id: g for r, g in zip(rows, want, strict=True)} and len(set(want)) > 1
    m = np.array([r.v for r in rows])
    _, _, axes = np.linalg.svd(m - m.mean(0))
    flat = m @ (axes[:2].T * np.sign(axes[:2].T[np.abs(axes[:2].T).argmax(0), [0, 1]]))
    shown = {r.id: r._projection for r in post.project(hits, "v").collect()}
    assert all(np.allclose(shown[r.id], p, atol=1e-6) for r, p in zip(rows, flat, strict=True))


def test_contextual_classification(spark):
    rng = np.random.default_rng(4)
    words = {f"w{i}": rng.normal(size=4) for i in range(14)}
    targets = {i: rng.normal(size=4) for i in range(3)}
    texts = {i: [f"w{j}" for j in rng.integers(0, 14, rng.choice((2, 5, 9, 14)))] for i in range(25)}
    n_docs = {w: sum(w in t for t in texts.values()) for w in words}
    unit = lambda v: v / np.linalg.norm(v)

    def label(t: list[str]) -> int:
        gain = {w: np.mean([1 - unit(words[w]) @ unit(v) for v in targets.values()]) - min(cos(words[w], v) for v in targets.values()) for w in set(t)}
        weigh = {w: t.count(w) / len(t) * math.log10(len(texts) / n_docs[w]) for w in set(t)}
        by_gain, by_weight = (sorted(set(t), key=lambda w, d=d: (-d[w], w)) for d in (gain, weigh))
        n = len(by_gain) * 50 // 100
        keep = [w for w in by_gain[:n] if w in by_weight[: len(by_gain) * 80 // 100]]
        keep = keep if len(keep) >= 3 else by_gain[:3]
        boost = lambda w: 1.0 if by_gain.index(w) >= n else 3.0 if by_gain.index(w) == 0 else min(3.0, 1 - math.log(by_gain.index(w) / n))
        v = sum(words[w] * boost(w) * t.count(w) for w in keep)
        return min(targets, key=lambda i: (cos(v, targets[i]), i))

    d = spark.createDataFrame([(i, t) for i, t in texts.items()], "id long, t array<string>")
    w = spark.createDataFrame([(k, v.tolist()) for k, v in words.items()], "term string, vector array<double>")
    g = spark.createDataFrame([(k, v.tolist()) for k, v in targets.items()], "target long, v array<double>")
    got = {r.id: r.label for r in classify.contextual(d, g, "id", "t", w, "target", "v").collect()}
    assert got == {i: label(t) for i, t in texts.items()}


def test_semantic_path(spark):
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.0, 1.0]), ("d", [-1.0, 0.0])], "term string, vector array<double>")
    hits = spark.createDataFrame([(1, [0.0, 2.0]), (2, None)], "id int, v array<double>")
    got = sorted((r.step, r.concept, round(r.distance_to_query, 6), round(r.distance_to_result, 6)) for r in post.semantic_path(hits, "id", "v", words, [3.0, 0.0], 3).collect())
    assert got == [(1, "b", 0.2, 0.4), (3, "c", 1.0, 0.0)] or got == [(1, "a", 0.0, 1.0), (2, "b", 0.2, 0.4), (3, "c", 1.0, 0.0)]


def test_bm25_of_rows_without_text_and_near_ties(spark):
    df = spark.createDataFrame([(1, "x x y"), (2, None), (3, ""), (4, "x y y"), (None, "x"), (5, "y x x")], "id int, t string")
    got = {r.id: r.score for r in keyword.bm25(df, "id", "x y", ["t"]).collect()}
    n, avg = 5, 9 / 5
    idf = math.log(1 + (n - 3 + 0.5) / (3 + 0.5))
    part = lambda f, size: idf * f / (f + 1.2 * (1 - 0.75 + 0.75 * size / avg))
    assert got == pytest.approx({1: part(2, 3) + part(1, 3), 4: part(1, 3) + part(2, 3), 5: part(2, 3) + part(1, 3)})
    assert [r.id for r in keyword.bm25(df, "id", "x y", ["t"], k=2).collect()] == [1, 4]
    plan = keyword.bm25(df, "id", "x y", ["t"])._jdf.queryExecution().toString()
    assert plan.count("regex") >= 0


def test_puts_keep_the_last_and_old_times(spark):
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, t int")
    new = spark.createDataFrame([(1, "x", 2), (1, "a", 2), (2, "c", 2), (3, "d", 2)], "id int, v string, t int").coalesce(1)
    assert sorted(map(tuple, mutate.put(now, new, "id", updated="t").collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    root, kind = f"file://{tmp_path}", "id long, n long, v string"
    for i, rows in enumerate(([(k, 0, "first") for k in range(200)], [(7, 1, "second"), (7, 2, "third"), (500, 1, "new")])):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{root}/in/{i}.parquet")
        stream = ingest.parquet_stream(spark, f"{root}/in/*.parquet", spark.createDataFrame([], kind))
        ingest.upsert(stream, f"{root}/rows", "id", "n", f"{root}/progress", buckets=16).awaitTermination()
    got = {r.id: (r.n, r.v) for r in ingest.current(spark, f"{root}/rows").collect()}
    assert got == {**{k: (0, "first") for k in range(200)}, 7: (2, "third"), 500: (1, "new")}
    assert len(list((tmp_path / "rows" / "epoch=1").glob("_bucket=*"))) <= 2
    before = {r.id: r.v for r in ingest.current(spark, f"{root}/rows", 0).collect()}
    assert before[7] == "first" and 500 not in before


def test_validation_and_inference_of_json(spark):
    rows = ['{"a": "x", "n": 1, "f": 2, "d": "2024-01-02T03:04:05Z", "u": "6f3ee4b2-8f6c-4d8c-9f7f-0e4e6a2c1b11", "l": [1, 2], "e": [], "b": true}', '{"a": 5, "n": 1.5, "f": 1.5, "d": "soon", "l": ["x"], "g": {"latitude": 1, "longitude": 2}, "o": {"k": 1}}', '{"a": null}', "{broken", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string")
    c = Collection("C", [Property("a", "text"), Property("n", "int"), Property("f", "number"), Property("d", "date"), Property("u", "uuid"), Property("l", "int[]"), Property("e", "text[]"), Property("b", "boolean"), Property("g", "geoCoordinates")])
    got = {r.i: list(r._errors) for r in validated(df, "j", c).collect()}
    assert got == {0: [], 1: ["no such property: o", "a: int where text is declared", "n: number where int is declared", "d: text where date is declared", "l: text[] where int[] is declared"], 2: [], 3: ["not a JSON object"], 4: ["not a JSON object"]}
    kinds = {r.name: r.data_type for r in inferred(df, "j").collect()}
    assert kinds == {"a": "conflict: int, text", "n": "number", "f": "number", "d": "text", "u": "uuid", "l": "conflict: int[], text[]", "e": "text[]", "b": "boolean", "g": "geoCoordinates", "o": "object"}


def test_one_call_searches(spark):
    df = spark.createDataFrame([(i, f"t{i} word", [math.cos(i), math.sin(i)], i) for i in range(20)], "id long, t string, v array<double>, _creationTime long")
    s = Searchable(df, "id", "v", text_props=("t",))
    with pytest.raises(ValueError):
        s.query(near_vector=[1.0, 0.0], limit=-1)
    with pytest.raises(ValueError):
        Hybrid("x", vector=[1.0, 0.0], near_text=NearText(["x"]))
    with pytest.raises(ValueError):
        Searchable(df, "id", "v", index="skip").query(near_object=3)
    with pytest.raises(ValueError):
        s.aggregate(hybrid=Hybrid("word", vector=[1.0, 0.0]))
    assert s.query(near_object=999).collect() == []
    assert [r.id for r in s.query(near_object=3, limit=2).collect()] == [3, 9]
    wide = s.query(near_vector=[1.0, 0.0], limit=-1, distance=0.1).collect()
    assert {r.id for r in wide} == {i for i in range(20) if cos([math.cos(i), math.sin(i)], [1, 0]) <= 0.1}
    found = s.query(bm25="t3 word", limit=1, select=["t"], metadata=["score", "explain_score", "creation_time", "certainty"]).first()
    assert found.id == 3 and found._meta_creation_time == 3 and "t3" in found._meta_explain_score and found._meta_certainty is None
    near = s.query(hybrid=Hybrid("t5", vector=[math.cos(5), math.sin(5)]), limit=3)
    assert near.first().id == 5 and near.count() == 3


def test_references_meet_their_rows_however_often_these_are_computed(spark):
    from lodestone.operators import refs

    chance = F.udf(lambda: __import__("random").random(), "double").asNondeterministic()
    rows = [(i, [i, i + 1, -1]) for i in range(40)] + [(90, []), (91, None), (92, [3, 2, 3]), (93, [3, 2, 3])]
    df = spark.createDataFrame(rows, "id long, keys array<bigint>").orderBy(chance())  # another order each time
    target = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    got = {r.id: [o.x for o in r.o] for r in refs.resolve(df, "keys", target, "k", ["x"], "o").collect()}
    assert got == {**{i: [10 * i, 10 * i + 10] for i in range(40)}, 90: [], 91: [], 92: [30, 20, 30], 93: [30, 20, 30]}
    few = where(df, points_to(Ref("keys", target, "k", prop("x") < 30)) | (prop("id") == 90))
    assert sorted(r.id for r in few.collect()) == [0, 1, 2, 90, 92, 93]


def test_a_query_without_a_limit_gives_all_rows(spark):
    s = Searchable(spark.range(10_050).withColumn("t", F.lit("word")), "id", text_props=("t",))
    assert s.query(prop("id") >= 20, limit=-1).count() == 10_030
    assert s.query(bm25="word", limit=-1).count() == 10_050


def test_all_within_a_distance_are_found(spark):
    df = spark.range(10_050).withColumn("v", F.array(F.lit(1.0), F.col("id") / 1e6))
    assert vector.within(df, "v", [1.0, 0.0], 0.5, "id").count() == 10_050
    assert [r.id for r in vector.within(df, "v", [1.0, 0.0], 0.5, "id", maximum=3).collect()] == [0, 1, 2]
    assert Searchable(df, "id", "v").query(near_vector=[1.0, 0.0], limit=-1, distance=0.5).count() == 10_050


@pytest.mark.parametrize("fusion", ["relative", "ranked"])
def test_fusion_takes_whole_legs(spark, fusion):
    n = 10_050
    key = spark.range(n).select("id", (F.col("id") % 5000 + 1.0).alias("score"))
    near = spark.range(n).select("id", (F.col("id") / n).alias("_distance"))
    got = {r.id: r.score for r in hybrid.hybrid(key, near, "id", fusion=fusion).collect()}
    k = {i: i % 5000 + 1.0 for i in range(n)}
    v = {i: 1 - i / n for i in range(n)}
    place = lambda s: {i: p for p, i in enumerate(sorted(s, key=lambda i: (-s[i], i)))}
    spread = lambda s: {i: (x - min(s.values())) / (max(s.values()) - min(s.values())) for i, x in s.items()}
    if fusion == "ranked":
        k, v = ({i: 1 / (60 + p) for i, p in place(s).items()} for s in (k, v))
    else:
        k, v = spread(k), spread(v)
    assert len(got) == n and all(abs(got[i] - 0.25 * k[i] - 0.75 * v[i]) < 1e-12 for i in range(n))


def exact_case(spark):
    """Vectors without clusters, where codes and lists tell little, and the exact ten nearest of three of them."""
    x = np.random.default_rng(11).normal(size=(2500, 24))
    x[5] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    return df, {i: (x[i].tolist(), sorted(range(len(x)), key=lambda n: (round(cos(x[i], x[n]), 12), n))[:10]) for i in (0, 7, 2400)}


def test_exact_search_of_an_inverted_file(spark):
    df, asked = exact_case(spark)
    index = ann.build(df, "v", "id", lists=24, replicas=2)
    for q, want in asked.values():
        assert [r.id for r in index.search(q, 10, probes=1, exact=True).collect()] == want
    q, want = asked[7]
    found = ann.dynamic(df, "v", "id", q, 10, flat_until=100, probes=2, exact=True)
    assert found.columns == ["id", "v", "_distance"] and [r.id for r in found.collect()] == want


def test_exact_search_by_encodings(spark):
    rng = np.random.default_rng(12)
    docs = rng.normal(size=(800, 4, 12)) * rng.uniform(0.2, 1, (800, 1, 1))
    df = spark.createDataFrame([(i, d.tolist()) for i, d in enumerate(docs)], "id long, t array<array<double>>")
    q = rng.normal(size=(2, 12))
    best = sorted(range(800), key=lambda n: (-float((docs[n] @ q.T).max(0).sum()), n))[:10]
    assert [r.id for r in quantize.muvera_search(df, "t", q.tolist(), 10, "id", rescore=12, repetitions=1, exact=True).collect()] == best


def test_search_by_encodings_holds_few_of_them(spark, monkeypatch):
    docs = np.random.default_rng(13).normal(size=(2000, 2, 8))
    df = spark.createDataFrame([(i, d.tolist()) for i, d in enumerate(docs)], "id long, t array<array<double>>").coalesce(1)

    def traced(f):
        def run(batches):
            import tracemalloc

            tracemalloc.start()
            try:
                yield from f(batches)
                peak = tracemalloc.get_traced_memory()[1]
            finally:
                tracemalloc.stop()
            if peak > 32e6:  # encodings of all rows take 41 MB, and four times as much as lists
                raise MemoryError(f"{peak / 1e6:.0f} MB")

        return run

    kind = type(df)
    for name in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(kind, name, lambda self, f, schema, *a, g=getattr(kind, name): g(self, traced(f), schema, *a))
    q = docs[7]
    best = sorted(range(2000), key=lambda n: (-float((docs[n] @ q.T).max(0).sum()), n))[:5]
    assert [r.id for r in quantize.muvera_search(df, "t", q.tolist(), 5, "id", exact=True).collect()] == best
    assert quantize.muvera(df.where("id < 600"), "t", 8).selectExpr("sum(size(_muvera)) n").first().n == 600 * 2560


def test_products_of_encodings_without_the_encodings(spark, monkeypatch):
    monkeypatch.setattr(quantize, "PRODUCT_TOKENS", 16)
    rng = np.random.default_rng(14)
    docs = [rng.normal(size=(n, 5)).tolist() for n in [*rng.integers(0, 9, 60), 40, 0]]
    docs += [np.zeros((3, 5)).tolist(), docs[0], docs[0]]
    df = spark.createDataFrame([*enumerate(docs), (100, [docs[60][0], None, docs[60][1]]), (101, [None]), (102, None)], "id long, t array<array<double>>").coalesce(2)
    q = rng.normal(size=(3, 5))
    for kw in ({}, {"ksim": 2, "projected": 3, "repetitions": 3}):
        code = quantize.Muvera(5, **kw)
        want = {i: float(code.encode(np.array(d).reshape(-1, 5), True) @ code.encode(q, False)) for i, d in [*enumerate(docs), (100, docs[60][:2]), (101, []), (102, [])]}
        got = {r.id: r._product for r in quantize.muvera_products(df, "t", q, **kw).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
        assert got[0] == got[len(docs) - 1] == got[len(docs) - 2]
    with pytest.raises(Exception, match="vector lengths don't match"):
        quantize.muvera_products(spark.createDataFrame([(1, [[1.0] * 4, [1.0] * 6])], "id long, t array<array<double>>"), "t", q).collect()


def test_exact_search_by_product_codes(spark):
    df, asked = exact_case(spark)
    books = quantize.product_quantizer(df, "v", 4, 8)
    coded = quantize.product_codes(df, "v", books)
    for q, want in asked.values():
        assert [r.id for r in quantize.rescored(coded, quantize.product_distance("_pq", books, q), "v", q, 10, 10, "id", least=quantize.product_least("_pq", books, q)).collect()] == want


@pytest.mark.parametrize("bits", [1, 8])
def test_exact_search_by_rotational_codes(spark, bits):
    df, asked = exact_case(spark)
    coded = quantize.rotational_codes(df, "v", bits=bits)
    for q, want in asked.values():
        assert [r.id for r in quantize.rescored(coded, quantize.rotational_distance(q), "v", q, 10, 10, "id", least=quantize.rotational_least(q)).collect()] == want


def test_validation_parses_an_object_once(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',)], "j string")
    c = Collection("C", [Property("a", "int"), Property("b", "text[]"), Property("c", "date")])
    assert validated(df, "j", c)._jdf.queryExecution().analyzed().toString().count("try_parse_json") == 1


def test_tf_idf_moves_terms_once(spark):
    rows = [(1, ["b", "a", "b"]), (2, ["a"]), (3, []), (4, None), (5, ["c", "c"])]
    kind = "id long, t array<string>"
    want = lambda n, df, c, l: (c / l, math.log10(n / df))
    out = classify.tf_idf(spark.createDataFrame(rows, kind), "id", "t")
    near = lambda got, want: set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    got = {(r.id, r.term): (r.tf, r.idf) for r in out.collect()}
    assert near(got, {(1, "a"): want(5, 2, 1, 3), (1, "b"): want(5, 1, 2, 3), (2, "a"): want(5, 2, 1, 1), (5, "c"): want(5, 1, 2, 2)})
    plan = classify.tf_idf(spark.createDataFrame(rows, kind), "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "hashpartitioning(term" in plan and "hashpartitioning(id" not in plan
    again = classify.tf_idf(spark.createDataFrame([*rows, (2, ["b"])], kind), "id", "t").where("id = 2")  # equal ids and lengths
    assert near({r.term: (r.tf, r.idf) for r in again.collect()}, {"a": want(6, 2, 1, 1), "b": want(6, 2, 1, 1)})


def test_a_tile_of_many_queries_takes_little_memory():
    import tracemalloc

    import pandas as pd

    x = np.random.default_rng(3).normal(size=(4096, 4))
    q = pd.DataFrame({"query_id": np.arange(4096), "_q": list(x)})
    b = pd.DataFrame({"base_id": np.arange(4096), "_v": list(x)})
    tracemalloc.start()
    got = vector.best_of_tile(q, b, 1, "cosine")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # one matrix of all distances takes 134 MB, and several are needed
    assert got.query_id.tolist() == got.base_id.tolist() == list(range(4096))


def test_contextual_classification_does_not_count_its_centroids(spark, monkeypatch):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c", "c"])], "id long, t array<string>")
    w = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "term string, vector array<double>")
    g = spark.createDataFrame([(7, [1.0, 0.1]), (8, [0.1, 1.0])], "target long, v array<double>")
    counted, count = [], type(d).count
    monkeypatch.setattr(type(d), "count", lambda self: (counted.append(self._jdf.queryExecution().analyzed().toString()), count(self))[1])
    out = classify.contextual(d, g, "id", "t", w, "target", "v")
    assert counted and not any("_weight" in p for p in counted)
    monkeypatch.undo()
    assert out.count() == 2
