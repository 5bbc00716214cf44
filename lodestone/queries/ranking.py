"""Keyword ranking, fusion, and what happens to hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import hybrid, keyword, modules, post, vector
from lodestone.plans.query import Hybrid, NearText, Searchable
from lodestone.queries.registry import concept_sql, cosine_sql, mod26_sql, query, read, shown, shown_sql, words_sql
from lodestone.queries.registry import vector as qv
from lodestone.queries.registry import vector_sql as qs

ASKED = "thea ention the ing ing"
TERMS = {"thea": 1, "ention": 1, "ing": 2}
W = words_sql()
TAGS = words_sql("lang || ' ' || source || ' ing thea'")


def docs(spark, sf):
    return read(spark, sf, "documents").withColumn("tags", F.concat_ws(" ", "lang", "source", F.lit("ing thea")))


def bm25_sql(props: dict[str, tuple[str, int]], terms: dict[str, int], minimum: int | dict[str, int] = 1, mode: str = "block", where: str = "true", table: str = "documents", id_col: str = "doc_id", by_prop: dict[str, dict[str, int]] | None = None) -> str:
    """props: name -> (tokens, boost); by_prop: query terms of each property where they differ."""
    names = list(props)
    toks = ", ".join(f"{t} AS t_{p}" for p, (t, _) in props.items())
    mean = " + ".join(f"avg(len(t_{p}))" for p in names)
    asked = by_prop or {p: terms for p in names}
    post_rows = " UNION ALL ".join(f"SELECT id, '{p}' AS prop, {b} AS boost, len(t_{p}) AS length, unnest(t_{p}) AS term FROM d" for p, (_, b) in props.items())
    values = ", ".join(f"('{p}', '{t}', {c})" for p, found in asked.items() for t, c in found.items())
    kept = "SELECT p.* FROM p" if where == "true" else f"SELECT p.* FROM p WHERE id IN (SELECT {id_col} FROM {table} WHERE {where})"
    if mode == "merged":
        kept = f"SELECT id, '{names[0]}' AS prop, 1 AS boost, term, sum(f * boost) AS f, sum(length) AS length FROM ({kept}) GROUP BY id, term"
    need = minimum if isinstance(minimum, int) else "CASE prop " + " ".join(f"WHEN '{p}' THEN {n}" for p, n in minimum.items()) + " END"
    return f"""
WITH d AS (SELECT {id_col} AS id, {toks} FROM (SELECT * FROM {table})),
s AS (SELECT count(*) AS n, ({mean}) / {len(names)} AS avg_len FROM d),
q(prop, term, times) AS (VALUES {values}),
p AS (SELECT id, prop, boost, term, count(*) AS f, first(length) AS length FROM ({post_rows}) WHERE (prop, term) IN (SELECT (prop, term) FROM q) GROUP BY id, prop, boost, term),
n AS (SELECT term, floor(sum(c) / count(*)) AS n_t FROM (SELECT term, prop, count(*) AS c FROM p GROUP BY term, prop) GROUP BY term),
k AS ({kept}),
per AS (SELECT id, prop, list_sum(list_sort(list(boost * ln(1 + (s.n - n_t + 0.5) / (n_t + 0.5)) * times * f / (f + 1.2 * (1 - 0.75 + 0.75 * length / s.avg_len))))) AS s, count(DISTINCT k.term) AS m
  FROM k JOIN n USING (term) JOIN q USING (prop, term), s GROUP BY id, prop)
SELECT id AS {id_col}, list_sum(list_sort(list(s))) AS score FROM per WHERE m >= {need} GROUP BY id"""


ONE, TWO = {"text": (W, 1)}, {"text": (W, 1), "tags": (TAGS, 3)}
TOP = " ORDER BY score DESC, doc_id LIMIT 50"


@query("q_k1_bm25", shown_sql(bm25_sql(ONE, TERMS) + TOP, "score"))
def _(spark, sf):
    return shown(keyword.bm25(docs(spark, sf), "doc_id", ASKED, ["text"], k=50), "score")


@query("q_k2_idf", f"SELECT term, count(*) AS n, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM (SELECT doc_id, unnest(list_distinct({W})) AS term FROM documents) WHERE term IN ('thea', 'ention', 'ing') GROUP BY term")
def _(spark, sf):
    d = docs(spark, sf)
    n = d.count()
    per = keyword.postings(d, "doc_id", "text", ["thea", "ention", "ing"], "word").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("idf", F.round(F.log(1 + (n - F.col("n") + 0.5) / (F.col("n") + 0.5)), 6))


@query("q_k6_block", shown_sql(bm25_sql(TWO, TERMS) + TOP, "score"))
def _(spark, sf):
    return shown(keyword.bm25(docs(spark, sf), "doc_id", ASKED, ["text", "tags^3"], k=50), "score")


@query("q_k7_merged", shown_sql(bm25_sql(TWO, TERMS, mode="merged") + TOP, "score"))
def _(spark, sf):
    return shown(keyword.bm25(docs(spark, sf), "doc_id", ASKED, ["text", "tags^3"], k=50, mode="merged"), "score")


@query("q_k11_and", shown_sql(bm25_sql(ONE, TERMS, minimum=3), "score"))
def _(spark, sf):
    return shown(keyword.bm25(docs(spark, sf), "doc_id", ASKED, ["text"], operator="And"), "score")


@query("q_k11_minimum", shown_sql(bm25_sql(ONE, TERMS, minimum=2), "score"))
def _(spark, sf):
    return shown(keyword.bm25(docs(spark, sf), "doc_id", ASKED, ["text"], minimum_match=2), "score")


@query("q_k11_and_by_property", shown_sql(bm25_sql({"text": (W, 1), "tags": (r"list_filter(regexp_split_to_array(lang || ' ' || source || ' ing thea', '[\s]+'), lambda x: x <> '')", 1)}, {}, {"text": 2, "tags": 3}, by_prop={"text": {"thea": 1, "ing": 1}, "tags": {"the": 1, "thea": 1, "ing": 1}}), "score"))
def _(spark, sf):
    # "the" is a stop-word of the one property's tokenization only, so the two ask for different numbers of terms
    return shown(keyword.bm25(docs(spark, sf), "doc_id", "the thea ing", ["text", "tags"], {"tags": "whitespace"}, operator="And"), "score")


@query("q_k14_explain", f"SELECT doc_id, term, count(*) AS frequency, first(l) AS prop_length FROM (SELECT doc_id, len({W}) AS l, unnest({W}) AS term FROM documents) WHERE term IN ('thea', 'ention') GROUP BY doc_id, term")
def _(spark, sf):
    hits = keyword.bm25(docs(spark, sf), "doc_id", "thea ention", ["text"], explain=True)
    return hits.select("doc_id", F.explode("explain").alias("x")).select("doc_id", F.col("x.term").alias("term"), F.col("x.frequency").alias("frequency"), F.col("x.propLength").cast("long").alias("prop_length"))


@query("q_k15_filtered", shown_sql(bm25_sql(ONE, TERMS, where="lang = 'en' AND doc_id % 2 = 0") + TOP, "score"))
def _(spark, sf):
    d = docs(spark, sf)
    return shown(keyword.bm25(d, "doc_id", ASKED, ["text"], k=50, allow=d.where("lang = 'en' AND doc_id % 2 = 0")), "score")


@query("q_k10_whitespace", shown_sql(bm25_sql({"text": (r"list_filter(regexp_split_to_array(text, '[\s\x0b\x{85}\p{Z}]+'), lambda x: x <> '')", 1)}, {"The": 1, "of": 1}) + TOP, "score"))
def _(spark, sf):
    return shown(keyword.bm25(docs(spark, sf), "doc_id", "The of", ["text"], {"text": "whitespace"}, k=50), "score")


@query("q_k16_missing_index", "SELECT 'text has no searchable index' AS error")
def _(spark, sf):
    try:
        keyword.bm25(docs(spark, sf), "doc_id", "x", ["text"], not_searchable=frozenset({"text"}))
        said = "none"
    except ValueError as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "error string")


# Documents get the vector of the same number; ids beyond the vectors have none.
KEY = f"({bm25_sql(ONE, TERMS)}{TOP})"
VEC = f"(SELECT doc_id, {cosine_sql('CAST(embedding AS DOUBLE[])', qs())} AS _distance FROM documents JOIN embeddings ON doc_id = vec_id ORDER BY 2, 1 LIMIT 50)"
LEGS = f"k AS (SELECT doc_id, score FROM {KEY}), v AS (SELECT doc_id, 1 - _distance AS score FROM {VEC})"


def legs(spark, sf):
    d = docs(spark, sf)
    k = keyword.bm25(d, "doc_id", ASKED, ["text"], k=50)
    e = d.select("doc_id").join(read(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id")).select("doc_id", "embedding")
    return k, vector.knn(e, "embedding", qv(), 50, "doc_id").select("doc_id", "_distance")


def fused_sql(part_k: str, part_v: str) -> str:
    return f"WITH {LEGS} SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT doc_id, {part_k} AS s FROM k UNION ALL SELECT doc_id, {part_v} FROM v) GROUP BY doc_id"


def rank_sql(w: float) -> str:
    return f"{w}::DOUBLE / (59 + row_number() OVER (ORDER BY score DESC, doc_id))"


def relative_sql(w: float) -> str:
    return f"{w}::DOUBLE * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ())"


@query("q_h1_ranked", fused_sql(rank_sql(0.25), rank_sql(0.75)))
def _(spark, sf):
    return shown(hybrid.hybrid(*legs(spark, sf), "doc_id", fusion="ranked").select("doc_id", "score"), "score")


@query("q_h2_relative", fused_sql(relative_sql(0.25), relative_sql(0.75)))
def _(spark, sf):
    return shown(hybrid.hybrid(*legs(spark, sf), "doc_id").select("doc_id", "score"), "score")


@query("q_h3_vector_leg", f"SELECT doc_id, round(1 - _distance, 6) AS score FROM {VEC}")
def _(spark, sf):
    return legs(spark, sf)[1].select("doc_id", F.round(1 - F.col("_distance"), 6).alias("score"))


@query("q_h4_alpha_one", f"WITH {LEGS} SELECT doc_id, round({relative_sql(1.0)}, 6) AS score FROM v")
def _(spark, sf):
    return shown(hybrid.hybrid(*legs(spark, sf), "doc_id", alpha=1.0).select("doc_id", "score"), "score")


@query("q_h4_alpha_zero", f"WITH {LEGS} SELECT doc_id, round({relative_sql(1.0)}, 6) AS score FROM k")
def _(spark, sf):
    return shown(hybrid.hybrid(*legs(spark, sf), "doc_id", alpha=0.0).select("doc_id", "score"), "score")


@query("q_h6_threshold", f"WITH v0 AS (SELECT * FROM {VEC} WHERE _distance <= 0.95), k AS (SELECT doc_id, score FROM {KEY} WHERE doc_id IN (SELECT doc_id FROM v0)), v AS (SELECT doc_id, 1 - _distance AS score FROM v0) SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT doc_id, {rank_sql(0.25)} AS s FROM k UNION ALL SELECT doc_id, {rank_sql(0.75)} FROM v) GROUP BY doc_id")
def _(spark, sf):
    return shown(hybrid.hybrid(*legs(spark, sf), "doc_id", fusion="ranked", max_distance=0.95).select("doc_id", "score"), "score")


WHY = f"SELECT doc_id, sum(s) AS t, max(raw) AS raw, string_agg(w, '; ' ORDER BY w) AS explain FROM (SELECT doc_id, s, score AS raw, printf('keyword %.6f', s) AS w FROM (SELECT doc_id, score, {relative_sql(0.25)} AS s FROM k) UNION ALL SELECT doc_id, s, score, printf('vector %.6f', s) FROM (SELECT doc_id, score, {relative_sql(0.75)} AS s FROM v)) GROUP BY doc_id"


@query("q_h9_explain", f"WITH {LEGS} SELECT doc_id, explain FROM ({WHY}) ORDER BY round(t, 7) DESC, raw DESC, doc_id DESC LIMIT 10")
def _(spark, sf):
    return hybrid.hybrid(*legs(spark, sf), "doc_id", limit=10).select("doc_id", "explain")


ITEMS = {"text": (words_sql(), 1)}
ITEM_LEGS = f"k AS ({bm25_sql(ITEMS, {'thea': 1, 'ing': 1}, table='benchmark', id_col='item_id')}), v AS (SELECT item_id, 1 - {cosine_sql('v', 'q')} AS score FROM (SELECT item_id, {mod26_sql('text')} AS v FROM benchmark), (SELECT {concept_sql(['of the', 'thea'], (['ing'], 0.5))} AS q))"


def items(spark, sf) -> Searchable:
    d = modules.vectorize(read(spark, sf, "benchmark"), "text", model="bigram-mod26")
    return Searchable(d, "item_id", "_vector", text_props=("text",), vectorizer="bigram-mod26")


@query("q_h8_near_text", f"WITH {ITEM_LEGS} SELECT item_id, round(t, 6) AS score FROM (SELECT item_id, sum(s) AS t, max(raw) AS raw FROM (SELECT item_id, {relative_sql(0.4)} AS s, score AS raw FROM k UNION ALL SELECT item_id, {relative_sql(0.6)}, score FROM v) GROUP BY item_id) ORDER BY round(t, 7) DESC, raw DESC, item_id DESC LIMIT 15")
def _(spark, sf):
    h = Hybrid("thea ing", near_text=NearText(["of the", "thea"], (["ing"], 0.5)), alpha=0.6)
    return shown(items(spark, sf).query(hybrid=h, limit=15, select=["item_id"]), "score")


ALL_LEGS = f"k AS ({bm25_sql(ONE, TERMS)}), v AS (SELECT doc_id, 1 - {cosine_sql('CAST(embedding AS DOUBLE[])', qs())} AS score FROM documents JOIN embeddings ON doc_id = vec_id)"


@query("q_h10_aggregate", f"WITH {ALL_LEGS}, f AS (SELECT doc_id FROM (SELECT doc_id, sum(s) AS t, max(raw) AS raw FROM (SELECT doc_id, {relative_sql(0.25)} AS s, score AS raw FROM k UNION ALL SELECT doc_id, {relative_sql(0.75)}, score FROM v) GROUP BY doc_id) ORDER BY round(t, 7) DESC, raw DESC, doc_id DESC LIMIT 40) SELECT lang AS _group, count(*) AS meta_count, CAST(sum(n_chars) AS DOUBLE) AS n_chars_sum FROM f JOIN documents USING (doc_id) GROUP BY lang ORDER BY 2 DESC, 1")
def _(spark, sf):
    d = docs(spark, sf).join(read(spark, sf, "embeddings").drop("label"), F.col("doc_id") == F.col("vec_id"), "left")
    s = Searchable(d, "doc_id", "embedding", text_props=("text",))
    return s.aggregate({"n_chars": "numeric"}, group_by="lang", hybrid=Hybrid(ASKED, vector=qv()), object_limit=40).select("_group", "meta_count", "n_chars_sum")


@query("q_a15_keyword_scope", f"SELECT count(*) AS meta_count, CAST(sum(n_chars) AS DOUBLE) AS n_chars_sum FROM ({bm25_sql(ONE, TERMS)} ORDER BY score DESC, doc_id LIMIT 25) JOIN documents USING (doc_id)")
def _(spark, sf):
    s = Searchable(docs(spark, sf), "doc_id", text_props=("text",))
    return s.aggregate({"n_chars": "numeric"}, bm25=ASKED, object_limit=25).select("meta_count", "n_chars_sum")


HITS = f"(SELECT vec_id, label, {cosine_sql('CAST(embedding AS DOUBLE[])', qs())} AS _distance FROM embeddings ORDER BY 3, 1 LIMIT 60)"


def hits(spark, sf, n: int = 60):
    return vector.knn(read(spark, sf, "embeddings"), "embedding", qv(), n, "vec_id")


GAP = "(_distance - first(_distance) OVER w) / (last(_distance) OVER w - first(_distance) OVER w) - (row_number() OVER o - 1) / 59.0::DOUBLE"


@query("q_r1_autocut", shown_sql(f"WITH h AS {HITS}, g AS (SELECT vec_id, _distance, row_number() OVER o AS i, {GAP} AS g FROM h WINDOW o AS (ORDER BY _distance, vec_id), w AS (ORDER BY _distance, vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), p AS (SELECT *, CASE WHEN i = 1 THEN 0 WHEN i = 60 THEN CASE WHEN g > lag(g) OVER o AND g > lag(g, 2) OVER o THEN 1 ELSE 0 END WHEN g > lag(g) OVER o AND g > lead(g) OVER o THEN 1 ELSE 0 END AS peak FROM g WINDOW o AS (ORDER BY i)) SELECT vec_id, _distance FROM (SELECT *, sum(peak) OVER (ORDER BY i) AS c FROM p) WHERE c < 2", "_distance"))
def _(spark, sf):
    return shown(post.autocut(hits(spark, sf), "_distance", ["_distance", "vec_id"], 2).select("vec_id", "_distance"), "_distance")


GROUPED = f"WITH h AS {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY _distance, vec_id) AS n FROM h), k AS (SELECT label FROM r WHERE n = 1 ORDER BY _distance, vec_id LIMIT 4), g AS (SELECT r.* FROM r JOIN k USING (label) WHERE n <= 5) "


@query("q_r2_group_by", shown_sql(GROUPED + "SELECT label AS value, vec_id, _distance, n FROM g", "_distance"))
def _(spark, sf):
    g = post.group_by(hits(spark, sf), "label", ["_distance", "vec_id"], 4, 5)
    return shown(g.select(F.col("_value").alias("value"), "vec_id", "_distance", F.col("_in_group").cast("long").alias("n")), "_distance")


@query("q_r3_group_summary", GROUPED + "SELECT label AS value, count(*) AS count, round(min(_distance), 6) AS min_distance, round(max(_distance), 6) AS max_distance FROM g GROUP BY label")
def _(spark, sf):
    out = post.group_summary(post.group_by(hits(spark, sf), "label", ["_distance", "vec_id"], 4, 5)).withColumnRenamed("_value", "value")
    return shown(out, "min_distance", "max_distance")


@query("q_r2_group_array", f"WITH h AS (SELECT vec_id, _distance, unnest(list_distinct([label, label % 3])) AS g FROM {HITS}), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY _distance, vec_id) AS n FROM h), k AS (SELECT g FROM r WHERE n = 1 ORDER BY _distance, vec_id, g LIMIT 50) SELECT r.g AS value, vec_id, n FROM r JOIN k USING (g) WHERE n <= 2")
def _(spark, sf):
    several = hits(spark, sf).withColumn("g", F.array("label", F.col("label") % 3))
    g = post.group_by(several, "g", ["_distance", "vec_id"], 50, 2, is_array=True)
    return g.select(F.col("_value").alias("value"), "vec_id", F.col("_in_group").cast("long").alias("n"))


@query("q_r4_group_keyword", shown_sql(f"WITH h AS (SELECT k.doc_id, k.score, lang FROM ({bm25_sql(ONE, TERMS)}{TOP}) k JOIN documents USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS n FROM h) SELECT lang AS value, doc_id, score FROM r WHERE n <= 3", "score"))
def _(spark, sf):
    d = docs(spark, sf)
    k = keyword.bm25(d, "doc_id", ASKED, ["text"], k=50).join(d.select("doc_id", "lang"), "doc_id")
    return shown(post.group_by(k, "lang", [F.desc("score"), "doc_id"], 10, 3).select(F.col("_value").alias("value"), "doc_id", "score"), "score")


@query("q_r5_semantic_groups")
def _(spark, sf):
    return post.semantic_groups(hits(spark, sf), "embedding", ["_distance", "vec_id"], 0.3).select("vec_id", "_group")


@query("q_r6_merge_group", "SELECT n_regionkey, CASE WHEN count(*) > 1 THEN list(n_name ORDER BY n_nationkey)[1] || ' (' || array_to_string(list(n_name ORDER BY n_nationkey)[2:], ', ') || ')' ELSE first(n_name) END AS n_name, avg(n_nationkey) AS n_nationkey FROM nation GROUP BY n_regionkey")
def _(spark, sf):
    n = read(spark, sf, "nation").withColumn("k", F.col("n_nationkey"))
    return post.merge_group(n, ["n_regionkey"], ["k"], texts=["n_name"], numbers=["n_nationkey"])


@query("q_r6_merge_kinds", "SELECT n_regionkey, count_if(n_nationkey % 2 = 0) >= count_if(n_nationkey % 2 <> 0) AS even, round(avg(n_nationkey), 6) AS lat, round(avg(-n_nationkey), 6) AS lon, array_to_string(list_sort(list_distinct(flatten(list([n_nationkey % 3, n_nationkey % 4])))), ',') AS refs FROM nation GROUP BY n_regionkey")
def _(spark, sf):
    k = F.col("n_nationkey")
    n = read(spark, sf, "nation").select("n_regionkey", "n_nationkey", (k % 2 == 0).alias("even"), F.struct(k.cast("double").alias("latitude"), (-k).cast("double").alias("longitude")).alias("at"), F.array(k % 3, k % 4).alias("refs"))
    out = post.merge_group(n, ["n_regionkey"], ["n_nationkey"], booleans=["even"], geos=["at"], refs=["refs"])
    return out.select("n_regionkey", "even", F.round("at.latitude", 6).alias("lat"), F.round("at.longitude", 6).alias("lon"), F.array_join(F.transform("refs", lambda x: x.cast("string")), ",").alias("refs"))


@query("q_r7_deduplicate", "SELECT user_id, min(value) AS value FROM events GROUP BY user_id")
def _(spark, sf):
    return post.deduplicate(read(spark, sf, "events").select("user_id", "value"), "user_id", "value")


@query("q_r8_rerank", f"WITH k AS ({bm25_sql(ONE, TERMS)}{TOP}) SELECT doc_id, CAST(strlen(text) AS DOUBLE) AS _rerank FROM k JOIN documents USING (doc_id)")
def _(spark, sf):
    d = docs(spark, sf)
    k = keyword.bm25(d, "doc_id", ASKED, ["text"], k=50).join(d.select("doc_id", "text"), "doc_id")
    return post.rerank(k, "text", ASKED, "doc_id").select("doc_id", "_rerank")


@query("q_r9_generate_single", "SELECT n_nationkey, 'Nothing was generated. The prompt is: Tell of ' || n_name || '.' AS _generated FROM nation")
def _(spark, sf):
    return post.generate_single(read(spark, sf, "nation"), "Tell of {n_name}.").select("n_nationkey", "_generated")


@query("q_r9_generate_grouped", """SELECT 'Nothing was generated. The prompt is: Compare: [' || string_agg('{"r_name":"' || r_name || '"}', ',' ORDER BY r_regionkey) || ']' AS _generated FROM region""")
def _(spark, sf):
    return post.generate_grouped(read(spark, sf, "region"), "Compare", ["r_name"], ["r_regionkey"])


@query("q_r10_projection")
def _(spark, sf):
    return post.project(hits(spark, sf), "embedding").select("vec_id", F.round(F.col("_projection")[0], 6).alias("x"), F.round(F.col("_projection")[1], 6).alias("y"))


@query("q_r12_provider_missing", "SELECT 'provider ''remote'' is not configured' AS error")
def _(spark, sf):
    try:
        post.rerank(docs(spark, sf), "text", ASKED, "doc_id", model="remote")
        said = "none"
    except ValueError as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "error string")


@query("q_m4_registered", "SELECT doc_id, CAST(len(string_split(text, 'thea')) - 1 AS DOUBLE) AS _rerank, upper(lang) || '!' AS _generated, left(text, 20) AS _summary, CASE WHEN contains(text, 'thea') THEN 'yes' ELSE 'no' END AS _answer FROM documents")
def _(spark, sf):
    # A user's own functions under names of their own, as local stands for remote models.
    post.RERANKERS["occurrences"] = lambda asked, text: (F.size(F.split(text, asked)) - 1).cast("double")
    post.GENERATORS["loud"] = lambda prompt: F.concat(F.upper(prompt), F.lit("!"))
    post.SUMMARIES["head"] = lambda text: F.left(text, F.lit(20))
    post.ANSWERS["contains"] = lambda asked, text: F.when(F.contains(text, F.lit(asked)), "yes").otherwise("no")
    out = post.rerank(docs(spark, sf), "text", "thea", "doc_id", "occurrences")
    out = post.answer(post.summarize(post.generate_single(out, "{lang}", "loud"), "text", "head"), "thea", "text", "contains")
    return out.select("doc_id", "_rerank", "_generated", "_summary", "_answer")


def word_vectors(spark, sf):
    words = read(spark, sf, "part").select(F.explode(tx.tokens("p_name")).alias("term")).distinct()
    return modules.vectorize(words, "term", "vector", "bigram-mod26").where(F.exists("vector", lambda x: x > 0))


TERM_VECTORS = f"(SELECT term, {mod26_sql('term')} AS v FROM (SELECT DISTINCT unnest({words_sql('p_name')}) AS term FROM part) WHERE length(regexp_replace(term, '[^a-z]+', '', 'g')) > 1)"
ITEM_VECTORS = f"(SELECT item_id, {mod26_sql('text')} AS v FROM benchmark)"


@query("q_r11_nearest_words", f"SELECT item_id, concept, round(d, 6) AS _distance, CAST(r AS INTEGER) AS _rank FROM (SELECT item_id, term AS concept, d, row_number() OVER (PARTITION BY item_id ORDER BY round(d, 12), term) AS r FROM (SELECT i.item_id, t.term, {cosine_sql('i.v', 't.v')} AS d FROM {ITEM_VECTORS} i, {TERM_VECTORS} t)) WHERE r <= 3")
def _(spark, sf):
    s = items(spark, sf)
    return shown(post.nearest_words(s.df, "item_id", "_vector", word_vectors(spark, sf), 3), "_distance").select("item_id", "concept", "_distance", "_rank")


@query("q_r11_interpretation", f"WITH o AS (SELECT term, count(*) AS n FROM (SELECT unnest({words_sql('p_name')}) AS term FROM part) GROUP BY term), e AS (SELECT min(n) AS lo, max(n) AS hi FROM o) SELECT p_partkey, term AS concept, round(CASE WHEN hi > lo THEN 2 * (1 - ln(n / lo) / ln(hi / lo)) ELSE 1 END, 6) AS weight, n AS occurrence FROM (SELECT p_partkey, unnest(list_distinct({words_sql('p_name')})) AS term FROM part) JOIN o USING (term), e WHERE length(regexp_replace(term, '[^a-z]+', '', 'g')) > 1")
def _(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", tx.tokens("p_name").alias("t"))
    counts = p.select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("occurrence"))
    return shown(post.interpretation(p, "p_partkey", "t", word_vectors(spark, sf), counts), "weight")


@query("q_r11_semantic_path")
def _(spark, sf):
    s = items(spark, sf)
    query_vector = [1.0 if i in (3, 7, 19) else 0.1 for i in range(26)]
    return shown(post.semantic_path(s.query(near_vector=query_vector, limit=10), "item_id", "_vector", word_vectors(spark, sf), query_vector), "distance_to_query", "distance_to_result")
