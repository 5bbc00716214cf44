"""What happens to hits: autocut, grouping, merging, de-duplication, reranking, prompts, projection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def autocut(hits: DataFrame, y: str, order: list[str], jumps: int) -> DataFrame:
    """Cut a bounded, ordered result before its jumps-th extremum over the diagonal."""
    w = Window.orderBy(*order)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = hits.select("*", F.row_number().over(w).alias("_i"), F.count(F.lit(1)).over(every).alias("_n"), F.first(y).over(every).alias("_a"), F.last(y).over(every).alias("_z"))
    flat = F.col("_z") == F.col("_a")
    gap = F.when(flat, 0.0).otherwise((F.col(y) - F.col("_a")) / F.when(flat, 1).otherwise(F.col("_z") - F.col("_a"))) - (F.col("_i") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    df = df.withColumn("_g", gap)
    before, two, after = F.lag("_g").over(w), F.lag("_g", 2).over(w), F.lead("_g").over(w)
    peak = F.when(F.col("_i") == 1, False).when(F.col("_i") == F.col("_n"), (F.col("_g") > before) & (F.col("_g") > F.coalesce(two, before - 1))).otherwise((F.col("_g") > before) & (F.col("_g") > after))
    df = df.withColumn("_peaks", F.sum(F.when(peak, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keep = (F.col("_n") <= 1) | (F.col("_peaks") < jumps)
    return df.where(keep).select(hits.columns)


def group_by(hits: DataFrame, by: str, order: list[str], groups: int, per_group: int, is_array: bool = False) -> DataFrame:
    """Hits in groups: the first ``groups`` values to appear, with the best ``per_group`` hits of each."""
    df = hits.withColumn("_value", F.explode(F.array_distinct(by)) if is_array else F.col(by)).where("_value is not null")
    df = df.withColumn("_in_group", F.row_number().over(Window.partitionBy("_value").orderBy(*order)))
    heads = df.where("_in_group = 1").orderBy(*order).limit(groups).select("_value")
    return df.where(F.col("_in_group") <= per_group).join(F.broadcast(heads), "_value")  # at most `groups` rows


def group_summary(grouped: DataFrame, by: str = "_value", distance: str = "_distance") -> DataFrame:
    return grouped.groupBy(by).agg(F.count(F.lit(1)).alias("count"), F.min(distance).alias("min_distance"), F.max(distance).alias("max_distance"))


def deduplicate(hits: DataFrame, id_col: str, value: str) -> DataFrame:
    """One row of each id, that of the smaller value."""
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy(id_col).orderBy(value))).where("_r = 1").drop("_r")


def semantic_groups(hits: DataFrame, vec: str, order: list[str], force: float) -> DataFrame:
    """Greedy grouping of a bounded result: a hit joins the first group with any member nearer than force. Adds _group from 0."""
    schema = T.StructType([*hits.schema, T.StructField("_group", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_all").sort_values(order, kind="stable").reset_index(drop=True)
        m = np.stack(pdf[vec].to_list()).astype(np.float64) if len(pdf) else np.zeros((0, 1))
        n = np.linalg.norm(m, axis=1, keepdims=True)
        m = m / np.where(n > 0, n, 1)
        group = np.full(len(pdf), -1)
        for i in range(len(pdf)):
            near = group[:i][(1 - m[:i] @ m[i]) / 2 < force]
            group[i] = near.min() if len(near) else group[:i].max(initial=-1) + 1
        return pdf.assign(_group=group.astype("int32"))

    return hits.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, schema)  # a bounded result


def merge_group(df: DataFrame, by: list[str], order: list[str], texts: list[str] = (), numbers: list[str] = (), booleans: list[str] = (), geos: list[str] = (), refs: list[str] = ()) -> DataFrame:
    """One row of each group: texts "first (others)", means, majorities (a tie is true), geographic means, united references."""

    def text(c: str) -> Column:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(c).alias("_x")))), lambda s: s["_x"])
        seen = F.array_distinct(F.filter(ordered, lambda x: x.isNotNull()))
        return F.when(F.size(seen) > 1, F.concat(seen[0], F.lit(" ("), F.array_join(F.slice(seen, 2, F.size(seen)), ", "), F.lit(")"))).otherwise(F.get(seen, F.lit(0)))

    share = lambda c: F.count_if(F.col(c)) >= F.count_if(~F.col(c))
    geo = lambda c: F.struct(F.avg(f"{c}.latitude").alias("latitude"), F.avg(f"{c}.longitude").alias("longitude"))
    cols = [*(text(c).alias(c) for c in texts), *(F.avg(c).alias(c) for c in numbers), *(share(c).alias(c) for c in booleans), *(geo(c).alias(c) for c in geos), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in refs)]
    return df.groupBy(*by).agg(*cols)


RERANKERS: dict[str, Callable[[str, Column], Column]] = {"dummy": lambda query, text: F.octet_length(text).cast("double")}
GENERATORS: dict[str, Callable[[Column], Column]] = {"dummy": lambda prompt: F.concat(F.lit("Nothing was generated. The prompt is: "), prompt)}
SUMMARIES: dict[str, Callable[[Column], Column]] = {}
ANSWERS: dict[str, Callable[[str, Column], Column]] = {}


def provider(table: dict, name: str):
    if name not in table:
        raise ValueError(f"provider {name!r} is not configured")
    return table[name]


def rerank(hits: DataFrame, prop: str, query: str, id_col: str, model: str = "dummy") -> DataFrame:
    text = F.col(prop) if dict(hits.dtypes)[prop] == "string" else F.lit("")
    return hits.withColumn("_rerank", provider(RERANKERS, model)(query, F.coalesce(text, F.lit("")))).orderBy(F.desc("_rerank"), id_col)


def summarize(hits: DataFrame, prop: str, model: str) -> DataFrame:
    """hits with ``_summary`` of a property, by a registered function."""
    return hits.withColumn("_summary", provider(SUMMARIES, model)(F.col(prop)))


def answer(hits: DataFrame, question: str, prop: str, model: str) -> DataFrame:
    """hits with ``_answer`` to a question from a property, by a registered function."""
    return hits.withColumn("_answer", provider(ANSWERS, model)(question, F.col(prop)))


def prompt(template: str) -> Column:
    """{name} in a template stands for a column's value."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def generate_single(hits: DataFrame, template: str, model: str = "dummy") -> DataFrame:
    return hits.withColumn("_generated", provider(GENERATORS, model)(prompt(template)))


def generate_grouped(hits: DataFrame, task: str, props: list[str], order: list[str], model: str = "dummy") -> DataFrame:
    """One prompt over a bounded result."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct(*props)).alias("_j")))), lambda s: s["_j"])
    return hits.agg(provider(GENERATORS, model)(F.concat(F.lit(task + ": ["), F.array_join(rows, ","), F.lit("]"))).alias("_generated"))


def nearest_words(hits: DataFrame, id_col: str, vec: str, words: DataFrame, k: int = 10) -> DataFrame:
    """(id, concept, _distance, _rank): the words nearest to each hit's vector. words: (term, vector)."""
    from lodestone.operators.vector import nearest_of_each

    near = nearest_of_each(hits, words, k, id_col, "term", vec, "vector")
    return near.select(F.col("query_id").alias(id_col), F.col("base_id").alias("concept"), "_distance", "_rank")


def interpretation(hits: DataFrame, id_col: str, tokens: str, words: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, concept, weight, occurrence): the known words of a text in which its vector originates, and what each weighs.

    counts: (term, occurrence) over the corpus. A rare word weighs most: 2 * (1 - ln(occurrence / least) / ln(most / least)).
    """
    ends = counts.agg(F.min("occurrence").alias("_lo"), F.max("occurrence").alias("_hi"))  # one row
    spread = F.ln(F.col("_hi") / F.col("_lo"))
    weight = F.when(spread > 0, 2 * (1 - F.ln(F.col("occurrence") / F.col("_lo")) / spread)).otherwise(1.0)
    each = hits.select(id_col, F.explode(F.array_distinct(tokens)).alias("term")).join(words.select("term"), "term").join(counts, "term").join(F.broadcast(ends), how="cross")
    return each.select(id_col, F.col("term").alias("concept"), weight.alias("weight"), "occurrence")


def semantic_path(hits: DataFrame, id_col: str, vec: str, words: DataFrame, query: list[float], steps: int = 5) -> DataFrame:
    """(id, step, concept, distance_to_query, distance_to_result): words on the way from the query's vector to each hit's.

    The way is cut into steps + 1 equal parts; the word nearest to each cut is a station, a word that repeats is one station.
    """
    from lodestone.functions import distance as D
    from lodestone.operators.vector import nearest_of_each

    q = D.normalise(D.vector(query))
    cut = lambda i: F.zip_with(q, D.normalise(F.col(vec)), lambda a, b: a + (b - a) * F.lit(i / (steps + 1)))
    at = hits.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("_id"), F.col(vec).alias("_hit"), F.explode(F.array(*(F.struct(F.lit(i).alias("step"), cut(i).alias("v")) for i in range(1, steps + 1)))).alias("s"))
    at = at.select("_id", "_hit", F.col("s.step").alias("step"), F.col("s.v").alias("_at"), F.concat_ws(":", F.col("_id").cast("string"), F.col("s.step").cast("string")).alias("_key"))
    near = nearest_of_each(at, words, 1, "_key", "term", "_at", "vector").select(F.col("query_id").alias("_key"), F.col("base_id").alias("term"))
    first = at.join(near, "_key").join(words, "term").groupBy("_id", "term").agg(F.min("step").alias("step"), F.first("vector").alias("vector"), F.first("_hit").alias("_hit"))
    return first.select(F.col("_id").alias(id_col), "step", F.col("term").alias("concept"), D.cosine(F.col("vector"), q).alias("distance_to_query"), D.cosine(F.col("vector"), F.col("_hit")).alias("distance_to_result"))


def project(hits: DataFrame, vec: str, dims: int = 2) -> DataFrame:
    """Coordinates of a result's vectors along their principal components (Spark ML); each component's largest weight is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = hits.withColumn("_x", array_to_vector(F.col(vec).cast("array<double>")))
    model = PCA(k=dims, inputCol="_x", outputCol="_p").fit(df)
    axes = model.pc.toArray()
    sign = np.sign(axes[np.abs(axes).argmax(0), np.arange(dims)])
    turned = F.zip_with(vector_to_array("_p"), F.lit([float(x) for x in sign]), lambda a, b: a * b)
    return model.transform(df).withColumn("_projection", turned).drop("_x", "_p")
