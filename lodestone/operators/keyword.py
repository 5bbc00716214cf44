"""Keyword ranking by BM25 over one or several properties.

Statistics (documents, term counts, mean lengths) cover the whole collection; a filter restricts hits, not statistics.
Texts are read once: each gives its lengths, summed in place, and the postings of the query's terms, so what is shuffled is
what the query asks for. Scores are doubles as computed; nothing is ranked by rounded ones.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx

K1, B, DEFAULT_LENGTH = 1.2, 0.75, 40.0


def boosts(properties: list[str]) -> dict[str, int]:
    """``title^3`` counts three times."""
    return {p.partition("^")[0]: int(p.partition("^")[2] or 1) for p in properties}


def terms_of(query: str, tokenization: str, stopwords: list[str]) -> dict[str, int]:
    found = tx.query_tokens(query, tokenization)
    return dict(Counter(t for t in found if tokenization != "word" or t not in stopwords))


def postings(df: DataFrame, id_col: str, prop: str, terms: list[str], tokenization: str) -> DataFrame:
    """(id, term, f, length) for the given terms."""
    return scanned(df, id_col, {prop: (tokenization, terms)}).where("id is not null").drop("prop", "sum_length")


def scanned(df: DataFrame, id_col: str, props: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """One pass over the texts: (id, prop, term, f, length, sum_length), props: name -> (tokenization, terms).

    Rows of id null hold what the corpus' statistics need: for each property, f rows and the sum of their lengths. They
    are summed before the shuffle, so that only postings of the query's terms are moved. Rows whose own id is null are left out.
    """
    entry = "struct<id:{0},prop:string,term:string,length:int,size:bigint>".format(df.schema[id_col].dataType.simpleString())
    parts = []
    for p, (how, terms) in props.items():
        def of(t: Column) -> Column:
            size = F.coalesce(F.size(t), F.lit(0))
            whole = F.array(F.struct(F.lit(None).alias("id"), F.lit(p).alias("prop"), F.lit("").alias("term"), F.lit(0).alias("length"), size.cast("bigint").alias("size"))).cast(f"array<{entry}>")
            if not terms:
                return whole
            hits = F.transform(F.filter(t, lambda x: x.isin(terms)), lambda x: F.struct(F.col(id_col).alias("id"), F.lit(p).alias("prop"), x.alias("term"), size.alias("length"), F.lit(0).cast("bigint").alias("size"))).cast(f"array<{entry}>")
            return F.concat(whole, F.coalesce(hits, F.array().cast(f"array<{entry}>")))

        parts.append(F.transform(F.array(tx.tokens(p, how)), of)[0])  # tokens are computed once
    each = df.where(F.col(id_col).isNotNull()).select(F.explode(F.concat(*parts)).alias("x")).select("x.*")
    return each.groupBy("id", "prop", "term").agg(F.count(F.lit(1)).alias("f"), F.max("length").alias("length"), F.sum("size").alias("sum_length"))


def summed(part: Column) -> Column:
    """The sum of a few parts in the order of their size, so that equal parts have equal sums."""
    return F.aggregate(F.array_sort(F.collect_list(part)), F.lit(0.0), lambda a, x: a + x)


def bm25(df: DataFrame, id_col: str, query: str, properties: list[str], tokenization: dict[str, str] | None = None, k: int | None = None, k1: float = K1, b: float = B, operator: str = "Or", minimum_match: int = 1, mode: str = "block", allow: DataFrame | None = None, stopwords: list[str] | None = None, explain: bool = False, not_searchable: frozenset[str] = frozenset()) -> DataFrame:
    """(id, score), best first. mode block: properties are scored alone and summed; merged: lengths and counts are summed first.

    allow: ids that may be hits. operator And asks for all of a property's own query terms (in mode merged: for those of any).
    """
    for p in boosts(properties):
        if p in not_searchable or p not in df.columns:
            raise ValueError(f"{p} has no searchable index")
    boost, how = boosts(properties), tokenization or {}
    stop = tx.STOPWORDS["en"] if stopwords is None else stopwords
    asked = {p: terms_of(query, how.get(p, "word"), stop) for p in boost}
    seen = scanned(df, id_col, {p: (how.get(p, "word"), list(asked[p])) for p in boost})
    each = seen.where("id is null").groupBy().agg(F.coalesce(F.max("f"), F.lit(0)).alias("n"), (F.sum(F.col("sum_length") / F.col("f")) / len(boost)).alias("mean"))
    stats = each.select("n", F.when(F.col("mean") > 0, F.col("mean")).otherwise(DEFAULT_LENGTH).alias("avg_len"))
    posts = seen.where("id is not null").drop("sum_length")
    times = F.coalesce(*(F.when((F.col("prop") == p) & (F.col("term") == t), F.lit(c)) for p, found in asked.items() for t, c in found.items()), F.lit(1))
    weight = F.coalesce(*(F.when(F.col("prop") == p, F.lit(w)) for p, w in boost.items()))
    # A row for each query term: how many documents have it, by the mean over properties that do.
    df_prop = posts.groupBy("term", "prop").agg(F.count(F.lit(1)).alias("n_p"))
    df_term = df_prop.groupBy("term").agg(F.floor(F.sum("n_p") / F.count(F.lit(1))).alias("n_t"))
    idf = df_term.join(F.broadcast(stats), how="cross").select("term", "avg_len", F.log(1 + (F.col("n") - F.col("n_t") + 0.5) / (F.col("n_t") + 0.5)).alias("idf"))
    if allow is not None:
        posts = posts.join(allow.select(F.col(id_col).alias("id")), "id", "left_semi")
    posts = posts.withColumn("_times", times)
    if mode == "merged":
        posts = posts.groupBy("id", "term").agg(F.sum(F.col("f") * weight).alias("f"), F.sum("length").alias("length"), F.max("_times").alias("_times")).withColumn("prop", F.lit(next(iter(boost)))).withColumn("_w", F.lit(1))
        need = F.lit(len(set().union(*asked.values())))
    else:
        posts = posts.withColumn("_w", weight)
        need = F.coalesce(*(F.when(F.col("prop") == p, F.lit(len(found))) for p, found in asked.items()))
    scored = posts.join(F.broadcast(idf), "term")  # at most as many rows as the query has terms
    part = F.col("_w") * F.col("idf") * F.col("_times") * F.col("f") / (F.col("f") + k1 * (1 - b + b * F.col("length") / F.col("avg_len")))
    extra = [F.array_sort(F.collect_list(F.struct("prop", "term", F.col("f").alias("frequency"), F.col("length").alias("propLength")))).alias("explain")] if explain else []
    per = scored.groupBy("id", "prop").agg(summed(part).alias("s"), F.count_distinct("term").alias("matched"), *extra).where(F.col("matched") >= (need if operator == "And" else minimum_match))
    total = per.groupBy("id").agg(summed(F.col("s")).alias("score"), *([F.flatten(F.collect_list("explain")).alias("explain")] if explain else []))
    out = total.withColumnRenamed("id", id_col)
    return out.orderBy(F.desc("score"), id_col).limit(k) if k is not None else out
