"""Classification, vectorizers, streams and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import distance as D
from lodestone.functions import text as tx
from lodestone.operators import classify, modules, refs
from lodestone.operators.filters import prop
from lodestone.queries.registry import EMB, concept_sql, cosine_sql, dot_sql, mod26_sql, query, read, shared, shown, shown_sql, words_sql
from lodestone.sources.collection import Catalog, Collection
from lodestone.streaming import ingest

LABELLED = "vec_id % 4 <> 0"


def split(spark, sf):
    e = read(spark, sf, "embeddings")
    return e.where("vec_id % 4 = 0").drop("label"), e.where(LABELLED)


@query("q_c1_source_set", "SELECT vec_id FROM embeddings WHERE vec_id % 4 = 0 AND vec_id > 10 ORDER BY vec_id LIMIT 10000")
def _(spark, sf):
    from lodestone.operators.filters import where

    e = read(spark, sf, "embeddings").withColumn("refs", F.when(F.col("vec_id") % 4 != 0, F.array("label")).otherwise(F.array().cast("array<int>")))
    return where(e, (prop("len(refs)") == 0) & (prop("vec_id") > 10)).select("vec_id").orderBy("vec_id").limit(classify.LIMIT)


NEAR = f"SELECT u.vec_id, l.vec_id AS b, l.label, greatest(0, 1 - {dot_sql('u.e', 'l.e')} / (sqrt({dot_sql('u.e', 'u.e')}) * sqrt({dot_sql('l.e', 'l.e')}))) AS dist FROM {EMB} u, {EMB} l WHERE u.vec_id % 4 = 0 AND l.vec_id % 4 <> 0"
RANKED = f"SELECT vec_id, label, dist / 2 AS d, row_number() OVER (PARTITION BY vec_id ORDER BY round(dist, 12), b) AS r FROM ({NEAR})"
VOTES = f"SELECT vec_id, label, count(*) AS votes, avg(d) AS mean, min(d) AS closest FROM ({RANKED}) WHERE r <= 5 GROUP BY vec_id, label"


WON = f"SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, round(mean, 9), label) AS place FROM ({VOTES})"
C2 = f"SELECT vec_id, any_value(label) FILTER (place = 1) AS label, any_value(votes) FILTER (place = 1) AS winning, CAST(coalesce(sum(votes) FILTER (place > 1), 0) AS BIGINT) AS losing, round(any_value(mean) FILTER (place = 1), 6) AS mean_winning, round(any_value(closest) FILTER (place = 1), 6) AS closest_winning, round(sum(votes * mean) FILTER (place > 1) / sum(votes) FILTER (place > 1), 6) AS mean_losing, round(min(closest) FILTER (place > 1), 6) AS closest_losing, round(min(closest), 6) AS closest_overall FROM ({WON}) GROUP BY vec_id"


@query("q_c2_knn", C2)
def _(spark, sf):
    u, lab = split(spark, sf)
    return shown(classify.knn(u, lab, "vec_id", "embedding", "label", k=5), "mean_winning", "closest_winning", "mean_losing", "closest_losing", "closest_overall")


@query("q_c3_zero_shot", f"WITH t AS (SELECT c_custkey AS target, list(m ORDER BY pos) AS v FROM (SELECT c_custkey % 10 AS c_custkey, pos, avg(x) AS m FROM (SELECT c_custkey, unnest(range(64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM customer JOIN embeddings ON vec_id = c_custkey) GROUP BY 1, 2) GROUP BY 1) SELECT u.vec_id, t.target AS label FROM {EMB} u, t QUALIFY row_number() OVER (PARTITION BY u.vec_id ORDER BY round({cosine_sql('u.e', 't.v')}, 12), t.target) = 1")
def _(spark, sf):
    """All objects against label objects, whose vectors are the centroids of ten groups of customers."""
    e = read(spark, sf, "embeddings")
    groups = read(spark, sf, "customer").select((F.col("c_custkey") % 10).alias("target"), F.col("c_custkey").alias("vec_id")).join(e, "vec_id")
    targets = D.centroid(groups, "embedding", ["target"]).withColumnRenamed("embedding", "v")
    return classify.zero_shot(e, targets, "vec_id", "embedding", "target", "v").select("vec_id", "label")


TF_IDF = f"WITH w AS (SELECT doc_id, {words_sql()} AS t FROM documents), t AS (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM w), c AS (SELECT doc_id, l, term, count(*) AS c FROM t GROUP BY doc_id, l, term), d AS (SELECT term, count(*) AS df FROM c GROUP BY term) SELECT doc_id, term, round(c / l, 6) AS tf, round(log10((SELECT count(*) FROM documents) / df), 6) AS idf FROM c JOIN d USING (term)"


@query("q_c4_tf_idf", TF_IDF)
def _(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", tx.tokens("text").alias("t"))
    return classify.tf_idf(d, "doc_id", "t").select("doc_id", "term", F.round("tf", 6).alias("tf"), F.round("idf", 6).alias("idf"))


@query("q_c4_contextual")
def _(spark, sf):
    d = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), tx.tokens("text").alias("t"))
    words = modules.vectorize(d.select(F.explode("t").alias("term")).distinct(), "term", "vector", "bigram-mod26")
    targets = modules.vectorize(read(spark, sf, "benchmark"), "text", "v", "bigram-mod26")
    return classify.contextual(d, targets, "id", "t", words, "item_id", "v").select("id", "label")


@query("q_c5_write_back", f"SELECT vec_id, label, 'knn' AS scope, winning FROM ({C2})")
def _(spark, sf):
    u, lab = split(spark, sf)
    found = classify.knn(u, lab, "vec_id", "embedding", "label", k=5)
    out = classify.written_back(u.withColumn("label", F.lit(None).cast("int")), found, "vec_id", "label", "knn")
    return out.select("vec_id", "label", F.col("_label_meta.scope").alias("scope"), F.col("_label_meta.winning").alias("winning"))


LETTERS = "regexp_replace(lower(text), '[^a-z]+', '', 'g')"


@query("q_m1a_bigram", f"WITH s AS (SELECT item_id, {LETTERS} AS s FROM benchmark), p AS (SELECT item_id, length(s) - 1 AS n, substr(s, i, 2) AS pair FROM s, LATERAL (SELECT unnest(range(1, length(s))) AS i)) SELECT item_id, (ascii(pair) - 97) * 26 + ascii(substr(pair, 2, 1)) - 97 AS pos, round(count(*) / n, 6) AS share FROM p GROUP BY item_id, n, pair")
def _(spark, sf):
    v = modules.vectorize(read(spark, sf, "benchmark"), "text")
    return v.select("item_id", F.posexplode("_vector").alias("pos", "x")).where("x > 0").select("item_id", "pos", F.round("x", 6).alias("share"))


@query("q_m1a_mod26", f"WITH s AS (SELECT item_id, {LETTERS} AS s FROM benchmark), p AS (SELECT item_id, length(s) - 1 AS n, substr(s, i, 2) AS pair FROM s, LATERAL (SELECT unnest(range(1, length(s))) AS i)) SELECT item_id, (ascii(pair) + ascii(substr(pair, 2, 1)) - 194) % 26 AS pos, round(count(*) / n, 6) AS share FROM p GROUP BY item_id, n, 2")
def _(spark, sf):
    v = modules.vectorize(read(spark, sf, "benchmark"), "text", model="bigram-mod26")
    return v.select("item_id", F.posexplode("_vector").alias("pos", "x")).where("x > 0").select("item_id", "pos", F.round("x", 6).alias("share"))


@query("q_m1a_trigram", f"WITH s AS (SELECT item_id, {LETTERS} AS s FROM benchmark), p AS (SELECT item_id, length(s) - 2 AS n, substr(s, i, 3) AS trigram FROM s, LATERAL (SELECT unnest(range(1, length(s) - 1)) AS i)) SELECT item_id, trigram, round(count(*) / n, 6) AS share FROM p GROUP BY item_id, n, trigram")
def _(spark, sf):
    return modules.trigrams(read(spark, sf, "benchmark"), "item_id", "text").withColumn("share", F.round("share", 6))


@query("q_m1a_bytepairs", "WITH h AS (SELECT item_id, hex(encode(lower(text))) AS h FROM benchmark), p AS (SELECT item_id, length(h) / 2 - 1 AS n, substr(h, 2 * CAST(i AS BIGINT) - 1, 4) AS pair FROM h, LATERAL (SELECT unnest(range(1, CAST(length(h) / 2 AS BIGINT))) AS i)) SELECT item_id, pair, round(count(*) / n, 6) AS share FROM p GROUP BY item_id, n, pair")
def _(spark, sf):
    return modules.bytepairs(read(spark, sf, "benchmark"), "item_id", "text").withColumn("share", F.round("share", 6))


@query("q_v13_near_text", shown_sql(f"SELECT item_id, {cosine_sql('v', 'q')} AS _distance FROM (SELECT item_id, {mod26_sql('text')} AS v FROM benchmark), (SELECT {concept_sql(['the ention', 'thea'], (['of the'], 0.5), (['ing'], 0.3))} AS q) ORDER BY 2, 1 LIMIT 10", "_distance"))
def _(spark, sf):
    d = modules.vectorize(read(spark, sf, "benchmark"), "text", model="bigram-mod26")
    return modules.near_text(d, "_vector", ["the ention", "thea"], 10, "item_id", "bigram-mod26", (["of the"], 0.5), (["ing"], 0.3)).select("item_id", "_distance").withColumn("_distance", F.round("_distance", 6))


@query("q_m3_centroid", "SELECT c, pos, round(avg(x), 6) AS mean FROM (SELECT c_custkey % 10 AS c, unnest(range(64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM customer JOIN embeddings ON vec_id = c_custkey) GROUP BY c, pos")
def _(spark, sf):
    groups = read(spark, sf, "customer").groupBy((F.col("c_custkey") % 10).alias("c")).agg(F.collect_list("c_custkey").alias("refs"))
    out = refs.centroids(groups, "c", "refs", read(spark, sf, "embeddings"), "vec_id", "embedding")
    return out.select("c", F.posexplode("embedding").alias("pos", "x")).select("c", "pos", F.round("x", 6).alias("mean"))


@query("q_m8_autocorrect", "WITH v AS (SELECT DISTINCT p_type AS entry FROM part), w AS (SELECT p_type || 'X' AS word FROM part UNION SELECT 'Q' || substr(p_type, 2) FROM part UNION SELECT 'Q' || substr(p_type, 2, length(p_type) - 2) || 'Z' FROM part) SELECT word, min(levenshtein(word, entry)) AS edits FROM w, v WHERE levenshtein(word, entry) <= 2 GROUP BY word")
def _(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_type").alias("entry")).distinct()
    inner = F.expr("substring(entry, 2, length(entry) - 2)")
    w = p.select(F.explode(F.array(F.concat("entry", F.lit("X")), F.concat(F.lit("Q"), F.substring("entry", 2, 99)), F.concat(F.lit("Q"), inner, F.lit("Z")))).alias("word")).distinct()
    return modules.autocorrect(w, "word", p, "entry").select("word", F.col("edits").cast("long").alias("edits"))


@query("q_s18_stream_upsert", "WITH b AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id, event_id, value FROM b WHERE r = 1")
def _(spark, sf):
    like = read(spark, sf, "events")
    stream = ingest.parquet_stream(spark, sf, like, "events.parquet").select("user_id", "event_id", "value")
    root = shared(spark)
    q = ingest.upsert(stream, f"{root}/rows", "user_id", "event_id", f"{root}/progress")
    q.awaitTermination()
    return ingest.current(spark, f"{root}/rows")


@query("q_x_percolate", "SELECT event_id, 'high' AS matched FROM events WHERE value > 50 UNION ALL SELECT event_id, 'low' FROM events WHERE value < 1")
def _(spark, sf):
    return ingest.percolate(read(spark, sf, "events"), {"high": prop("value") > 50, "low": prop("value") < 1}).select("event_id", "matched")


@query("q_x_windowed_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    return ingest.windowed_counts(read(spark, sf, "events"), "ts", "event_type")


@query("q_s21_backup", "SELECT 'Nation' AS class, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation UNION ALL SELECT 'Document', count(*), CAST(sum(n_chars) AS BIGINT) FROM documents UNION ALL SELECT 'Order', count(*), CAST(sum(o_custkey) AS BIGINT) FROM orders")
def _(spark, sf):
    cat, of = Catalog(spark), {"Nation": ("nation", "n_nationkey"), "Document": ("documents", "n_chars"), "Order": ("orders", "o_custkey")}
    for n, (table, _) in of.items():
        cat.create(Collection(n, []), read(spark, sf, table))
    path = shared(spark)
    cat.restore(path, cat.backup(path))
    from functools import reduce

    return reduce(lambda a, b: a.union(b), (cat.read(n).agg(F.lit(n).alias("class"), F.count(F.lit(1)).alias("n"), F.sum(c).cast("long").alias("total")) for n, (_, c) in of.items()))


@query("q_m2_registered", "SELECT item_id, [CAST(length(text) AS DOUBLE), CAST(len(string_split(text, ' ')) AS DOUBLE)] AS v FROM benchmark")
def _(spark, sf):
    modules.register("lengths", lambda c: F.array(F.length(c).cast("double"), F.size(F.split(c, " ")).cast("double")))
    return modules.vectorize(read(spark, sf, "benchmark"), "text", "v", "lengths").select("item_id", "v")
