"""Scans, sorting, projection, mutations and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import mutate, refs
from lodestone.plans.query import Searchable
from lodestone.queries.registry import cosine_sql, query, read, vector, vector_sql
from lodestone.sources.collection import Catalog, Collection, Property, after, inferred, sort, validated

DOC = "doc_id, lang, source, n_chars"


def docs(spark, sf):
    return read(spark, sf, "documents")


@query("q_s1_list", f"SELECT {DOC} FROM documents ORDER BY doc_id LIMIT 100")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", "lang", "source", "n_chars").orderBy("doc_id").limit(100)


@query("q_s2_cursor", f"SELECT {DOC} FROM documents WHERE doc_id > 50 ORDER BY doc_id LIMIT 25")
def _(spark, sf):
    return after(docs(spark, sf).select("doc_id", "lang", "source", "n_chars"), "doc_id", 50, 25)


@query("q_s3_get", f"SELECT {DOC} FROM documents WHERE doc_id = 17")
def _(spark, sf):
    return docs(spark, sf).where("doc_id = 17").select("doc_id", "lang", "source", "n_chars")


@query("q_s4_multi_get", f"SELECT {DOC} FROM documents WHERE doc_id IN (3, 5, 8, 13, 21, 999999999)")
def _(spark, sf):
    return docs(spark, sf).where(F.col("doc_id").isin(3, 5, 8, 13, 21, 999999999)).select("doc_id", "lang", "source", "n_chars")


@query("q_s5_exists", "SELECT (SELECT count(*) FROM documents WHERE doc_id = 17) > 0 AS there, (SELECT count(*) FROM documents WHERE doc_id = -1) > 0 AS not_there")
def _(spark, sf):
    d = docs(spark, sf)
    one = lambda i, n: d.where(F.col("doc_id") == i).limit(1).agg((F.count(F.lit(1)) > 0).alias(n))
    return one(17, "there").join(F.broadcast(one(-1, "not_there")), how="cross")


@query("q_s6_rest_list", f"SELECT {DOC} FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 5")
def _(spark, sf):
    return sort(docs(spark, sf).select("doc_id", "lang", "source", "n_chars"), [("n_chars", "desc")], "doc_id", 10, 5)


@query("q_s7_cross_class_id", "SELECT 'Customer' AS class, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey = 12 UNION ALL SELECT 'Part', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey = 12 UNION ALL SELECT 'Document', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id = 12")
def _(spark, sf):
    cat = Catalog(spark)
    ids = {"Customer": ("customer", "c_custkey"), "Part": ("part", "p_partkey"), "Document": ("documents", "doc_id")}
    for n, (t, _) in ids.items():
        cat.create(Collection(n, []), read(spark, sf, t))
    return cat.find(12, {n: c for n, (_, c) in ids.items()})


CHANGED = "SELECT c_custkey, c_name || ' v2' AS c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 0"


def changed(spark, sf):
    c = read(spark, sf, "customer")
    return c, c.where("c_custkey % 10 = 0").withColumn("c_name", F.concat("c_name", F.lit(" v2"))).withColumn("c_acctbal", F.col("c_acctbal") + 1)


@query("q_s8_put", f"SELECT * FROM customer WHERE c_custkey % 10 <> 0 UNION ALL {CHANGED}")
def _(spark, sf):
    c, new = changed(spark, sf)
    return mutate.put(c, new, "c_custkey")


@query("q_s8_put_unchanged", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_name || ' v2' ELSE c_name END AS c_name, CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END AS updated FROM customer")
def _(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_name", F.lit(1).alias("updated"))
    again = c.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.concat("c_name", F.lit(" v2"))).otherwise(F.col("c_name")).alias("c_name"), F.lit(2).alias("updated"))
    return mutate.put(c, again, "c_custkey", updated="updated")


@query("q_s9_batch_put", "WITH b AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id, event_id, value FROM b WHERE r = 1")
def _(spark, sf):
    return mutate.last_of_each(read(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("q_s9_report", "SELECT user_id, event_id, CASE WHEN value > 90 THEN 'value' END AS error, (row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) AND NOT value > 90 AS stays FROM events")
def _(spark, sf):
    return mutate.put_report(read(spark, sf, "events"), "user_id", "event_id", F.when(F.col("value") > 90, "value"))


@query("q_s10_patch", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'patched' ELSE c_name END AS c_name, CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN [c_nationkey, 99] ELSE [c_nationkey] END AS refs FROM customer")
def _(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.array("c_nationkey").alias("refs"))
    new = c.where("c_custkey % 7 = 0").select("c_custkey", F.lit("patched").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"), F.array(F.lit(99)).alias("refs"), F.when(F.col("c_custkey") % 14 == 0, F.array(F.lit("c_mktsegment"))).otherwise(F.array().cast("array<string>")).alias("cleared"))
    return mutate.patch(c, new, "c_custkey", ["c_name", "c_mktsegment"], ["refs"], "cleared")


@query("q_s11_update", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_name || ' v2' ELSE c_name END AS c_name FROM customer")
def _(spark, sf):
    c, new = changed(spark, sf)
    strangers = new.withColumn("c_custkey", -F.col("c_custkey") - 1)
    return mutate.update(c, new.union(strangers), "c_custkey").select("c_custkey", "c_name")


@query("q_s12_delete", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def _(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey")
    return mutate.delete(c, c.where("c_custkey % 3 = 0"), "c_custkey")


@query("q_s13_delete_where", "SELECT count(*) AS matched, count(*) AS successful, CAST(0 AS BIGINT) AS failed FROM orders WHERE o_totalprice > 300000")
def _(spark, sf):
    return mutate.delete_counts(mutate.delete_where(read(spark, sf, "orders"), F.col("o_totalprice") > 300000, "o_orderkey")[1])


@query("q_s13_left", "SELECT o_orderkey FROM orders WHERE NOT o_totalprice > 300000")
def _(spark, sf):
    return mutate.delete_where(read(spark, sf, "orders"), F.col("o_totalprice") > 300000, "o_orderkey")[0].select("o_orderkey")


@query("q_s14_reference_edit", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN [7] ELSE list_filter([n_regionkey, 5], lambda x: x <> 1) END AS refs FROM nation")
def _(spark, sf):
    n = read(spark, sf, "nation").select("n_nationkey", F.array(F.col("n_regionkey"), F.lit(5)).alias("refs"))
    even = F.col("n_nationkey") % 2 == 0
    return mutate.delete_references(mutate.replace_references(n, "refs", F.array(F.lit(7)), even), "refs", F.array(F.lit(1)), ~even)


ORDERS_OF = "(SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS refs FROM orders GROUP BY o_custkey)"


@query("q_s15_batch_references", f"SELECT c_custkey, coalesce(refs, []) AS refs FROM customer LEFT JOIN {ORDERS_OF} o ON o_custkey = c_custkey")
def _(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", F.array().cast("array<bigint>").alias("refs"))
    edges = read(spark, sf, "orders").select(F.col("o_custkey").alias("from_id"), F.col("o_orderkey").alias("to_id"))
    return mutate.add_references(c, edges, "c_custkey", "refs")


def objects(spark, sf):
    """Events as JSON objects, some with values of the wrong kind."""
    count, when = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")), F.when(F.col("event_id") % 5 == 0, "soon").otherwise("2024-01-02T03:04:05Z")
    fields = {"name": F.col("event_type"), "size": F.col("value"), "count": count, "n": F.col("user_id"), "when": when, "at": F.struct(F.lit(1.5).alias("latitude"), F.lit(2).alias("longitude")), "tags": F.array(F.col("event_type"), F.lit("x"))}
    return read(spark, sf, "events").select("event_id", F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("object"))


@query("q_s16_validate", "SELECT event_id, concat_ws('; ', 'no such property: n', CASE WHEN event_id % 2 = 0 THEN 'count: text where int is declared' END, CASE WHEN event_id % 5 = 0 THEN 'when: text where date is declared' END) AS errors FROM events")
def _(spark, sf):
    c = Collection("C", [Property("name", "text"), Property("size", "number"), Property("count", "int"), Property("when", "date"), Property("at", "geoCoordinates"), Property("tags", "text[]")])
    return validated(objects(spark, sf), "object", c).select("event_id", F.array_join("_errors", "; ").alias("errors"))


@query("q_s17_auto_schema", "SELECT * FROM (VALUES ('at', 'geoCoordinates'), ('count', 'text'), ('n', 'int'), ('name', 'text'), ('size', 'number'), ('tags', 'text[]'), ('when', 'text')) AS t(name, data_type)")
def _(spark, sf):
    return inferred(objects(spark, sf), "object")


@query("q_s19_tenants", "SELECT doc_id, lang FROM documents WHERE source = 'src3'")
def _(spark, sf):
    cat = Catalog(spark)
    cat.create(Collection("Doc", [], multi_tenant=True), docs(spark, sf).withColumn("_tenant", F.col("source")))
    cat.set_tenant("Doc", "src3")
    cat.set_tenant("Doc", "src4", Catalog.COLD)
    return cat.read("Doc", "src3").select("doc_id", "lang")


@query("q_s20_ddl", "SELECT r_regionkey, r_name, 0 AS n_sizes, 'bigint' AS kind FROM region")
def _(spark, sf):
    cat = Catalog(spark)
    cat.create(Collection("Region", [Property("r_regionkey", "int"), Property("r_name", "text")]), read(spark, sf, "region"))
    cat.add_property("Region", Property("sizes", "int[]"))
    kind = cat.collections["Region"].schema()["sizes"].dataType.elementType.simpleString()
    return cat.read("Region").select("r_regionkey", "r_name", F.coalesce(F.size("sizes"), F.lit(0)).alias("n_sizes"), F.lit(kind).alias("kind"))


@query("q_s22_replicas", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_name || ' v2' ELSE c_name END AS c_name, CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END AS version FROM customer WHERE c_custkey % 4 <> 0")
def _(spark, sf):
    c, new = changed(spark, sf)
    a = c.select("c_custkey", "c_name", F.lit(1).alias("version"))
    b = mutate.put(a, new.select("c_custkey", "c_name", F.lit(2).alias("version")), "c_custkey").where("c_custkey % 4 <> 0")
    return mutate.newest_replica([a, b], "c_custkey", "version", need=2)


@query("q_s25_alias", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf):
    cat = Catalog(spark)
    cat.create(Collection("Nation", []), read(spark, sf, "nation"))
    cat.alias("Country", "Nation")
    return cat.read("Country").select("n_nationkey", "n_name")


@query("q_s26_shards", "SELECT CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 4 AS shard, count(*) AS objects FROM customer GROUP BY 1")
def _(spark, sf):
    return mutate.shards(read(spark, sf, "customer"), "c_custkey", 4)


@query("q_p1_select", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _(spark, sf):
    return read(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")


@query("q_p2_nested", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    e = read(spark, sf, "events").withColumn("p", F.from_json("props", "struct<k:bigint>"))
    return e.select("event_id", F.col("p.k").alias("k"))


@query("q_p2_nested_select", "SELECT c_custkey, c_name AS name, c_nationkey AS nation, [c_nationkey, c_nationkey + 1] AS keys FROM customer WHERE c_nationkey > 20")
def _(spark, sf):
    from lodestone.operators.filters import prop

    place = F.struct("c_nationkey", F.struct(F.col("c_name").alias("name"), "c_acctbal").alias("who"), F.array(*(F.struct((F.col("c_nationkey") + i).alias("k"), F.lit("x").alias("more")) for i in (0, 1))).alias("list"))
    d = read(spark, sf, "customer").select("c_custkey", place.alias("place"))
    out = Searchable(d, "c_custkey").query(prop("place.c_nationkey") > 20, limit=-1, select=["place.c_nationkey", "place.who.name", "place.list.k"])
    return out.select("c_custkey", F.col("place.who.name").alias("name"), F.col("place.c_nationkey").alias("nation"), F.col("place.list.k").alias("keys"))


@query("q_p4_metadata", f"SELECT vec_id, CAST(vec_id AS VARCHAR) AS id, round(_distance, 6) AS distance, round(1 - _distance / 2, 6) AS certainty, CAST(2000 + label AS BIGINT) AS created, CAST(64 AS INTEGER) AS dims FROM (SELECT vec_id, label, {cosine_sql('CAST(embedding AS DOUBLE[])', vector_sql())} AS _distance FROM embeddings ORDER BY 3, 1 LIMIT 12)")
def _(spark, sf):
    d = read(spark, sf, "embeddings").withColumn("_creationTime", (F.col("label") + 2000).cast("long"))
    out = Searchable(d, "vec_id", "embedding").query(near_vector=vector(), limit=12, select=[], metadata=["id", "distance", "certainty", "creation_time", "vector"])
    return out.select("vec_id", F.col("_meta_id").alias("id"), F.round("_meta_distance", 6).alias("distance"), F.round("_meta_certainty", 6).alias("certainty"), F.col("_meta_creation_time").alias("created"), F.size("_meta_vector").alias("dims"))


@query("q_p3_reference", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    n = refs.resolve(read(spark, sf, "nation"), "n_regionkey", read(spark, sf, "region"), "r_regionkey", ["r_name"], "region")
    c = refs.resolve(read(spark, sf, "customer"), "c_nationkey", n, "n_nationkey", ["n_name", "region"], "nation")
    return c.select("c_custkey", F.col("nation.n_name").alias("n_name"), F.col("nation.region.r_name").alias("r_name"))


@query("q_j1_reference_arrays", f"SELECT c_custkey, list_transform(coalesce(refs, []), lambda k: CAST(k AS VARCHAR)) AS keys, CAST(round(coalesce(total, 0), 2) AS DOUBLE) AS total FROM customer LEFT JOIN {ORDERS_OF} o ON o_custkey = c_custkey LEFT JOIN (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders GROUP BY 1) t ON t.k = c_custkey")
def _(spark, sf):
    orders = read(spark, sf, "orders")
    lists = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("refs"))
    c = read(spark, sf, "customer").select("c_custkey").join(lists, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<bigint>")))
    out = refs.resolve(c, "refs", orders, "o_orderkey", ["o_orderkey", "o_totalprice"], "orders")
    return out.select("c_custkey", F.transform("orders", lambda o: o["o_orderkey"].cast("string")).alias("keys"), F.round(F.aggregate("orders", F.lit(0.0), lambda s, o: s + o["o_totalprice"]), 2).alias("total"))


@query("q_j5_multi_class", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN s_name ELSE p_name END AS name FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey")
def _(spark, sf):
    line = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.struct(F.lit("Supplier").alias("class"), F.col("l_suppkey").alias("id"))).otherwise(F.struct(F.lit("Part").alias("class"), F.col("l_partkey").alias("id"))).alias("ref"))
    targets = {"Supplier": (read(spark, sf, "supplier").withColumnRenamed("s_name", "name"), "s_suppkey"), "Part": (read(spark, sf, "part").withColumnRenamed("p_name", "name"), "p_partkey")}
    return refs.resolve_many(line, "ref", targets, ["name"], "o").select("l_orderkey", "l_linenumber", F.col("o.name").alias("name"))


@query("q_j3_no_reference", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def _(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders").where("o_totalprice > 450000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("q_o1_sort", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY lower(p_brand), p_size DESC, p_partkey LIMIT 200")
def _(spark, sf):
    return sort(read(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), [("p_brand", "asc"), ("p_size", "desc")], "p_partkey", 200)


@query("q_o3_nulls_first", "SELECT doc_id, k FROM (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN n_chars END AS k FROM documents) ORDER BY k ASC NULLS FIRST, doc_id LIMIT 300")
def _(spark, sf):
    d = docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("n_chars")).alias("k"))
    return sort(d, [("k", "asc")], "doc_id", 300)


@query("q_o2_sort_arrays", "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, [lower(p_brand), lower(p_type)] AS k FROM part) ORDER BY k DESC, p_partkey LIMIT 100")
def _(spark, sf):
    mixed = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    p = read(spark, sf, "part").select("p_partkey", "p_size", F.array(mixed, "p_type").alias("k"))
    return sort(p, [("k", "desc")], "p_partkey", 100).drop("k")


@query("q_o7_sort_after_search", f"WITH h AS (SELECT vec_id, label, {cosine_sql('CAST(embedding AS DOUBLE[])', vector_sql())} AS _distance FROM embeddings ORDER BY 3, 1 LIMIT 20) SELECT vec_id, label, round(_distance, 6) AS _distance FROM h")
def _(spark, sf):
    s = Searchable(read(spark, sf, "embeddings"), "vec_id", "embedding")
    return s.query(near_vector=vector(), limit=20, sort_by=[("label", "desc")], select=["label"]).withColumn("_distance", F.round("_distance", 6))


@query("q_o8_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(spark, sf):
    return sort(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc")], "o_orderkey", 50, 100)
