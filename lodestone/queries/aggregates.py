"""Typed aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import aggregate as agg
from lodestone.operators.filters import prop
from lodestone.plans.query import Searchable
from lodestone.queries.registry import EMB, cosine_sql, query, read, vector, vector_sql

NUM = "count({c}) AS {p}_count, round(sum({c}), 4) AS {p}_sum, min({c}) AS {p}_minimum, max({c}) AS {p}_maximum, round(avg({c}), 6) AS {p}_mean"


def rounded(df, p):
    return df.withColumn(f"{p}_sum", F.round(f"{p}_sum", 4)).withColumn(f"{p}_mean", F.round(f"{p}_mean", 6))


@query("q_a1_meta_count", "SELECT count(*) AS meta_count FROM lineitem")
def _(spark, sf):
    return agg.aggregate(read(spark, sf, "lineitem"))


@query("q_a2_array_count", "SELECT CAST(count(*) AS BIGINT) AS n_count, round(sum(n), 4) AS n_sum, max(n) AS n_maximum FROM (SELECT unnest([CAST(o_custkey % 10 AS DOUBLE), CAST(o_orderkey % 7 AS DOUBLE)]) AS n FROM orders)")
def _(spark, sf):
    o = read(spark, sf, "orders").select(F.array((F.col("o_custkey") % 10).cast("double"), (F.col("o_orderkey") % 7).cast("double")).alias("n"))
    return agg.aggregate(o, {"n": "numeric"}).select("n_count", F.round("n_sum", 4).alias("n_sum"), "n_maximum")


MODE = "(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("q_a3_numeric", f"SELECT count(*) AS meta_count, {NUM.format(c='l_quantity', p='l_quantity')}, {MODE.format(c='l_quantity', t='lineitem')} AS l_quantity_mode, median(l_quantity) AS l_quantity_median FROM lineitem")
def _(spark, sf):
    return rounded(agg.aggregate(read(spark, sf, "lineitem"), {"l_quantity": "numeric"}), "l_quantity")


@query("q_a5_mode", f"SELECT CAST({MODE.format(c='p_size', t='part')} AS DOUBLE) AS p_size_mode, {MODE.format(c='p_retailprice', t='part')} AS p_retailprice_mode")
def _(spark, sf):
    return agg.aggregate(read(spark, sf, "part"), {"p_size": "numeric", "p_retailprice": "numeric"}).select("p_size_mode", "p_retailprice_mode")


@query("q_a6_median", "SELECT event_type, median(value) AS value_median FROM events GROUP BY event_type")
def _(spark, sf):
    return agg.aggregate(read(spark, sf, "events"), {"value": "numeric"}, "event_type").select(F.col("_group").alias("event_type"), "value_median")


@query("q_a7_empty", "SELECT CAST(0 AS BIGINT) AS value_count, CAST(NULL AS DOUBLE) AS value_sum, CAST(NULL AS DOUBLE) AS value_mode")
def _(spark, sf):
    return agg.aggregate(read(spark, sf, "events").where("event_id < 0"), {"value": "numeric"}).select("value_count", "value_sum", "value_mode")


@query("q_a8_boolean", "SELECT count(*) AS toxic_count, count_if(toxic = 1) AS toxic_total_true, count_if(toxic = 0) AS toxic_total_false, round(count_if(toxic = 1) / count(*), 6) AS toxic_percentage_true, round(count_if(toxic = 0) / count(*), 6) AS toxic_percentage_false FROM labels")
def _(spark, sf):
    out = agg.aggregate(read(spark, sf, "labels").select((F.col("toxic") == 1).alias("toxic")), {"toxic": "boolean"}).drop("meta_count")
    return out.withColumn("toxic_percentage_true", F.round("toxic_percentage_true", 6)).withColumn("toxic_percentage_false", F.round("toxic_percentage_false", 6))


@query("q_a9_top_occurrences", "SELECT source AS value, count(*) AS occurs FROM documents GROUP BY source ORDER BY occurs DESC, value LIMIT 5")
def _(spark, sf):
    return agg.top_occurrences(read(spark, sf, "documents"), "source")


@query("q_a9_top_by_group", "SELECT lang, source AS value, count(*) AS occurs FROM documents GROUP BY lang, source QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) <= 3")
def _(spark, sf):
    return agg.top_occurrences(read(spark, sf, "documents"), "source", ["lang"], 3)


DAYS = "(SELECT DISTINCT o_orderdate FROM orders)"


@query("q_a10_date", "SELECT count(*) AS n, epoch_us(min(o_orderdate)) AS low, epoch_us(max(o_orderdate)) AS high, epoch_us((SELECT o_orderdate FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS mode, CAST(floor(median(epoch_us(o_orderdate))) AS BIGINT) AS median FROM orders")
def _(spark, sf):
    out = agg.aggregate(read(spark, sf, "orders"), {"o_orderdate": "date"})
    us = lambda n, a: F.unix_micros(F.col(f"o_orderdate_{n}").cast("timestamp")).alias(a)
    return out.select(F.col("o_orderdate_count").alias("n"), us("minimum", "low"), us("maximum", "high"), us("mode", "mode"), us("median", "median"))


@query("q_a11_pointing_to", "SELECT array_to_string(list_sort(list_distinct(list(n_regionkey))), ',') AS pointing_to FROM nation")
def _(spark, sf):
    return agg.aggregate(read(spark, sf, "nation"), {"n_regionkey": "reference"}).select(F.array_join(F.transform("n_regionkey_pointing_to", lambda x: x.cast("string")), ",").alias("pointing_to"))


@query("q_a12_types", "SELECT o_orderpriority AS _group, count(*) AS meta_count, 'int' AS o_custkey_type, 'text' AS o_orderstatus_type, 'number' AS o_totalprice_type, 'date' AS o_orderdate_type, 'int[]' AS keys_type FROM orders GROUP BY 1")
def _(spark, sf):
    o = read(spark, sf, "orders").withColumn("keys", F.array("o_custkey", "o_orderkey"))
    return agg.aggregate(o, dict.fromkeys(("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "keys"), "type"), "o_orderpriority")


@query("q_a13_group_by", f"SELECT o_orderpriority AS _group, count(*) AS meta_count, {NUM.format(c='o_totalprice', p='o_totalprice')}, median(o_totalprice) AS o_totalprice_median FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def _(spark, sf):
    return rounded(agg.aggregate(read(spark, sf, "orders"), {"o_totalprice": "numeric"}, "o_orderpriority"), "o_totalprice").drop("o_totalprice_mode")


@query("q_a13_group_array", "SELECT g AS _group, count(*) AS meta_count FROM (SELECT o_orderkey, unnest(list_distinct([o_custkey % 5, o_orderkey % 5])) AS g FROM orders) GROUP BY g ORDER BY 2 DESC, 1 LIMIT 3")
def _(spark, sf):
    o = read(spark, sf, "orders").select(F.array(F.col("o_custkey") % 5, F.col("o_orderkey") % 5).alias("g"))
    return agg.aggregate(o, group_by="g", limit=3)


@query("q_a14_filtered", f"SELECT count(*) AS meta_count, {NUM.format(c='value', p='value')} FROM events WHERE event_type = 'click' AND value > 20")
def _(spark, sf):
    from lodestone.operators.filters import Schema

    s = Searchable(read(spark, sf, "events"), "event_id", schema=Schema({"event_type": "field"}))
    return rounded(s.aggregate({"value": "numeric"}, (prop("event_type") == "click") & (prop("value") > 20)), "value").drop("value_mode", "value_median")


@query("q_a15_search_scope", f"SELECT label AS _group, count(*) AS meta_count FROM (SELECT label FROM {EMB} ORDER BY {cosine_sql('e', vector_sql())}, vec_id LIMIT 50) GROUP BY label ORDER BY 2 DESC, 1")
def _(spark, sf):
    return Searchable(read(spark, sf, "embeddings"), "vec_id", "embedding").aggregate(group_by="label", near_vector=vector(), object_limit=50)


@query("q_a17_not_aggregatable", "SELECT 'geo can''t be aggregated' AS error")
def _(spark, sf):
    try:
        agg.aggregate(read(spark, sf, "nation").withColumn("geo", F.struct("n_nationkey")), {"geo": "numeric"})
        said = "none"
    except ValueError as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "error string")


@query("q_a18_dimensions", "SELECT 'embedding' AS target, count(embedding) AS objects, CAST(sum(len(embedding)) AS BIGINT) AS dimensions FROM embeddings")
def _(spark, sf):
    return agg.dimensions(read(spark, sf, "embeddings"), ["embedding"])
