"""Filters and tokenizers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators.filters import Ref, Schema, points_to, prop, where
from lodestone.queries.registry import blanks_sql, query, read, words_sql

DOCS = Schema({"text": "word", "lang": "field", "source": "field"})
W = words_sql()


def filtered(table: str, id_col: str, clause, schema: Schema = DOCS, prepare=lambda df: df):
    return lambda spark, sf: where(prepare(read(spark, sf, table)), clause(spark, sf) if callable(clause) else clause, schema).select(id_col)


def add(name: str, table: str, id_col: str, clause, condition: str, schema: Schema = DOCS, prepare=lambda df: df, source: str | None = None) -> None:
    query(name, f"SELECT {id_col} FROM {source or table} WHERE {condition}")(filtered(table, id_col, clause, schema, prepare))


# A column with gaps and arrays to filter by, in both engines.
GAPS = "(SELECT *, CASE WHEN doc_id % 5 > 0 THEN n_chars END AS size, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN lang END AS tag, CASE WHEN doc_id % 4 > 0 THEN [doc_id % 7, doc_id % 11] WHEN doc_id % 8 = 0 THEN [] END AS nums FROM documents)"


def gaps(df):
    nums = F.when(F.col("doc_id") % 4 > 0, F.array(F.col("doc_id") % 7, F.col("doc_id") % 11)).when(F.col("doc_id") % 8 == 0, F.array().cast("array<bigint>"))
    return df.withColumn("size", F.when(F.col("doc_id") % 5 > 0, F.col("n_chars"))).withColumn("tag", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("lang"))).withColumn("nums", nums)


def has(t: str) -> str:
    return f"list_contains({W}, '{t}')"


GAP = dict(table="documents", id_col="doc_id", prepare=gaps, source=GAPS)
add("q_f1_equal", "orders", "o_orderkey", prop("o_custkey") == 7, "o_custkey = 7")
add("q_f1_equal_array", **GAP, clause=prop("nums") == 3, condition="coalesce(list_contains(nums, 3), false)")
add("q_f2_equal_text", "documents", "doc_id", prop("text") == "the Ention, of with", f"{has('ention')}")
add("q_f2_equal_field", "documents", "doc_id", prop("lang") == "de", "lang = 'de'")
add("q_f3_not_equal", **GAP, clause=prop("size") != 1000, condition="NOT coalesce(size = 1000, false)")
add("q_f3_not_equal_text", "documents", "doc_id", prop("text") != "ention thea", f"NOT {has('ention')} AND NOT {has('thea')}")
add("q_f4_greater", **GAP, clause=prop("size") > 3000, condition="coalesce(size > 3000, false)")
add("q_f4_greater_equal_array", **GAP, clause=prop("nums") >= 9, condition="coalesce(len(list_filter(nums, lambda x: x >= 9)) > 0, false)")
add("q_f5_less", "orders", "o_orderkey", prop("o_totalprice") < 20000, "o_totalprice < 20000")
add("q_f5_less_equal", "part", "p_partkey", prop("p_size") <= 7, "p_size <= 7")
add("q_f6_range", "orders", "o_orderkey", (prop("o_totalprice") >= 100000) & (prop("o_totalprice") < 110000), "o_totalprice >= 100000 AND o_totalprice < 110000")
add("q_f7_like", "documents", "doc_id", prop("text").like("enti?n*"), f"len(list_filter({W}, lambda x: regexp_full_match(x, '(?s)enti.n.*'))) > 0")
add("q_f7_like_field", "part", "p_partkey", prop("p_name").like("red*"), "starts_with(trim(p_name), 'red')", Schema({"p_name": "field"}))
add("q_f8_null", **GAP, clause=prop("tag").is_null(), condition="tag IS NULL OR length(tag) = 0")
add("q_f8_null_array", **GAP, clause=prop("nums").is_null(), condition="nums IS NULL OR len(nums) = 0")
add("q_f8_not_null", **GAP, clause=prop("size").is_null(False), condition="size IS NOT NULL")
add("q_f9_any", "documents", "doc_id", prop("text").contains_any("ention", "thea", "the"), f"{has('ention')} OR {has('thea')}")
add("q_f9_any_numbers", **GAP, clause=prop("nums").contains_any(1, 2), condition="coalesce(list_has_any(nums, [1, 2]), false)")
add("q_f10_all", "documents", "doc_id", prop("text").contains_all("ing", "er"), f"{has('ing')} AND {has('er')}")
add("q_f11_none", **GAP, clause=prop("nums").contains_none(1, 2), condition="NOT coalesce(list_has_any(nums, [1, 2]), false)")
add("q_f12_and_or", "documents", "doc_id", ((prop("lang") == "fr") | (prop("lang") == "de")) & (prop("n_chars") > 2000), "lang IN ('fr', 'de') AND n_chars > 2000")
add("q_f13_not", **GAP, clause=~((prop("size") > 2000) | (prop("nums") == 3)), condition="NOT (coalesce(size > 2000, false) OR coalesce(list_contains(nums, 3), false))")
add("q_f15_id", "events", "event_id", prop("event_id") >= 900, "event_id >= 900")
add("q_f17_length", **GAP, clause=prop("len(tag)") == 0, condition="coalesce(length(tag), 0) = 0")
add("q_f17_length_array", **GAP, clause=prop("len(nums)") >= 2, condition="coalesce(len(nums), 0) >= 2")
add("q_f18_reference_count", **GAP, clause=prop("len(nums)") == 0, condition="coalesce(len(nums), 0) = 0")


@query("q_f14_geo", "SELECT c_custkey FROM customer WHERE 2 * 6371000.0 * atan2(sqrt(a), sqrt(1 - a)) <= 5000000".replace("FROM customer", "FROM (SELECT c_custkey, pow(sin(radians(lat - 10) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(lon - 20) / 2), 2) AS a FROM (SELECT c_custkey, CAST(c_custkey * 37 % 180 AS DOUBLE) - 89.5 AS lat, CAST(c_custkey * 53 % 360 AS DOUBLE) - 179.5 AS lon FROM customer)) t"))
def _(spark, sf):
    at = F.struct(((F.col("c_custkey") * 37 % 180).cast("float") - 89.5).cast("float").alias("latitude"), ((F.col("c_custkey") * 53 % 360).cast("float") - 179.5).cast("float").alias("longitude"))
    return where(read(spark, sf, "customer").withColumn("at", at), prop("at").within(10, 20, 5_000_000)).select("c_custkey")


@query("q_f16_times", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-03 12:00:00'")
def _(spark, sf):
    e = read(spark, sf, "events").withColumnRenamed("ts", "_creationTime")
    return where(e, (prop("_creationTime") >= F.lit("2024-01-02 00:00:00").cast("timestamp")) & (prop("_creationTime") < F.lit("2024-01-03 12:00:00").cast("timestamp"))).select("event_id")


@query("q_f19_reference_path", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7' AND c_acctbal > 0")
def _(spark, sf):
    s = Schema({"n_name": "field"})
    nation = Ref("c_nationkey", read(spark, sf, "nation"), "n_nationkey", prop("n_name") == "NATION_7", s)
    customer = Ref("o_custkey", read(spark, sf, "customer"), "c_custkey", points_to(nation) & (prop("c_acctbal") > 0))
    return where(read(spark, sf, "orders"), points_to(customer)).select("o_orderkey")


@query("q_j4_several_paths", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE s_nationkey = 3 AND p_size > 25 AND l_quantity > 10")
def _(spark, sf):
    s = Ref("l_suppkey", read(spark, sf, "supplier"), "s_suppkey", prop("s_nationkey") == 3)
    p = Ref("l_partkey", read(spark, sf, "part"), "p_partkey", prop("p_size") > 25)
    return where(read(spark, sf, "lineitem"), points_to(s) & points_to(p) & (prop("l_quantity") > 10)).select("l_orderkey", "l_linenumber")


@query("q_f19_negated_path", "SELECT o_orderkey FROM orders WHERE NOT o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) OR o_totalprice < 50000")
def _(spark, sf):
    customer = Ref("o_custkey", read(spark, sf, "customer"), "c_custkey", prop("c_acctbal") > 0)
    return where(read(spark, sf, "orders"), ~points_to(customer) | (prop("o_totalprice") < 50000)).select("o_orderkey")


UUID_SQL = "SELECT id FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM documents) WHERE doc_id = 12"


@query("q_f20_uuid", UUID_SQL)
def _(spark, sf):
    import hashlib

    h = F.md5(F.col("doc_id").cast("string").cast("binary"))
    d = read(spark, sf, "documents").select(F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))).alias("id"))
    wanted = "{" + hashlib.md5(b"12").hexdigest().upper() + "}"  # any spelling of an id will do
    return where(d, prop("id") == wanted, Schema({"id": "id"})).select("id")


@query("q_f21_missing_index", "SELECT 'lang has no index to filter by' AS error")
def _(spark, sf):
    try:
        where(read(spark, sf, "documents"), prop("lang") == "de", Schema(not_filterable=frozenset({"lang"}), not_searchable=frozenset({"lang"})))
        said = "none"
    except ValueError as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "error string")


# Tokenizers: how many tokens and how many different ones each document has.
TOKEN_SQL = {
    "t1_word": ("word", W), "t2_lowercase": ("lowercase", f"list_transform({blanks_sql()}, lambda x: lower(x))"), "t3_whitespace": ("whitespace", blanks_sql()), "t4_field": ("field", r"[regexp_replace(text, '^\s+|\s+$', '', 'g')]"),
    "t5_trigram": ("trigram", "list_concat({})".format(", ".join(rf"regexp_extract_all(substr(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g'), {i}), '...')" for i in (1, 2, 3)))),
}


def _tokenizer(name: str, how: str, sql: str) -> None:
    def run(spark, sf):
        d = read(spark, sf, "documents").select("doc_id", tx.tokens("text", how).alias("t"))
        return d.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_min("t").alias("first"))

    query(f"q_{name}", f"SELECT doc_id, len(t) AS n, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, list_min(t) AS first FROM (SELECT doc_id, {sql} AS t FROM documents)")(run)


for _name, (_how, _sql) in TOKEN_SQL.items():
    _tokenizer(_name, _how, _sql)


@query("q_t6_dictionary", r"SELECT doc_id, len(regexp_extract_all(text, '(?s)...')) AS n, (SELECT 'tokenization ''gse'' is not configured') AS error FROM documents")
def _(spark, sf):
    try:
        tx.tokens("text", "gse")
        said = "none"
    except ValueError as e:
        said = str(e)
    tx.register_tokenizer("threes", lambda c: F.regexp_extract_all(c, F.lit("(?s)..."), 0))  # a user's own
    return read(spark, sf, "documents").select("doc_id", F.size(tx.tokens("text", "threes")).cast("long").alias("n"), F.lit(said).alias("error"))


@query("q_t7_wildcards", f"SELECT p_partkey FROM part WHERE len(list_filter({words_sql('p_type')}, lambda x: regexp_full_match(x, 's.*l'))) > 0 AND len(list_filter({words_sql('p_type')}, lambda x: regexp_full_match(x, '.mal.*'))) > 0")
def _(spark, sf):
    return where(read(spark, sf, "part"), prop("p_type").like("S*L, ?mal*")).select("p_partkey")


@query("q_t8_counts", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({W}) AS term FROM documents) GROUP BY doc_id, term")
def _(spark, sf):
    return tx.token_counts(read(spark, sf, "documents"), "doc_id", "text")


STOPS = ", ".join(f"'{w}'" for w in tx.stopwords())


@query("q_t9_stopwords", f"SELECT doc_id, CAST(len(list_filter({W}, lambda x: x IN ({STOPS}))) AS BIGINT) AS n_stop FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(F.filter(tx.tokens("text"), lambda t: t.isin(tx.stopwords()))).cast("long").alias("n_stop"))


@query("q_t10_lengths", f"SELECT round(avg(len({W})), 6) AS mean_length FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").agg(F.round(F.avg(F.size(tx.tokens("text"))), 6).alias("mean_length"))

