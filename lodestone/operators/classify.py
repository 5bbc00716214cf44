"""Classification jobs: labels for objects that have none, from neighbours, label objects or term statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import distance as D
from lodestone.operators.vector import nearest_of_each
from lodestone.sources.collection import bound

LIMIT = 10_000


def knn(unlabelled: DataFrame, labelled: DataFrame, id_col: str, vec: str, label: str, k: int = 3, limit: int = LIMIT) -> DataFrame:
    """The majority label of the k nearest labelled objects; of equal counts that of the lower mean distance, then the lower label.

    Distances are (1 - cos) / 2: mean and closest of winners and of the rest, and closest of all.
    """
    todo = unlabelled.orderBy(id_col).limit(limit)
    near = nearest_of_each(todo, labelled, k, id_col, id_col, vec, vec, "cosine").withColumn("d", F.col("_distance") / 2)
    near = near.join(labelled.select(F.col(id_col).alias("base_id"), F.col(label).alias("label")), "base_id")
    votes = near.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"), F.avg("d").alias("mean"), F.min("d").alias("closest"), F.sum("d").alias("total"))
    # Means over the same distances in another order may differ in the last digits, so they are compared to nine.
    order = Window.partitionBy("query_id").orderBy(F.desc("votes"), F.round("mean", 9), "label")
    every = Window.partitionBy("query_id")
    votes = votes.withColumn("_r", F.row_number().over(order))
    lost = lambda c: F.when(F.col("_r") > 1, F.col(c))
    votes = votes.withColumn("closest_overall", F.min("closest").over(every)).withColumn("closest_losing", F.min(lost("closest")).over(every)).withColumn("_n", F.sum(lost("votes")).over(every)).withColumn("_t", F.sum(lost("total")).over(every)).withColumn("losing", F.coalesce("_n", F.lit(0)))
    return votes.where("_r = 1").select(F.col("query_id").alias(id_col), "label", F.col("votes").alias("winning"), "losing", F.col("mean").alias("mean_winning"), F.col("closest").alias("closest_winning"), (F.col("_t") / F.col("_n")).alias("mean_losing"), "closest_losing", "closest_overall")


def zero_shot(objects: DataFrame, targets: DataFrame, id_col: str, vec: str, target_id: str, target_vec: str, most: int | None = None) -> DataFrame:
    """The nearest object of the target collection. most: how many objects there are at most, if that is known."""
    return nearest_of_each(objects, targets, 1, id_col, target_id, vec, target_vec, most=most).select(F.col("query_id").alias(id_col), F.col("base_id").alias("label"), "_distance")


def counted(tokens: Column) -> Column:
    """(term, n) of a list's different tokens: runs of the sorted list."""
    starts = lambda t: F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))
    run = lambda t, s: F.transform(s, lambda i, j: F.struct(F.get(t, i - 1).alias("term"), (F.coalesce(F.get(s, j + 1), F.size(t) + 1) - i).cast("long").alias("_c")))
    return F.when(F.size(tokens) > 0, bound(F.array_sort(tokens), lambda t: bound(starts(t), lambda s: run(t, s))))


def tf_idf(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """(id, term, tf, idf, tf_idf): tf = count / length, idf = log10(N / documents with the term)."""
    return _tf_idf(df, id_col, tokens).select(id_col, "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tf_idf"))


def _tf_idf(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """(id, term, _c, tf, idf). Terms are counted within their row and moved once, by term, to be joined without a sort with the
    count of their documents, which tasks sum before. Only where ids repeat are the counts of equal ids added before."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    each = df.select(id_col, F.size(tokens).alias("_len"), F.inline(counted(F.col(tokens))))
    if df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_r")).where("_r > 1").limit(1).count():
        each = each.groupBy(id_col, "_len", "term").agg(F.sum("_c").alias("_c"))
    docs = each.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).join(F.broadcast(n), how="cross")  # one row
    out = each.join(docs.hint("shuffle_hash"), "term").withColumn("tf", F.col("_c") / F.col("_len"))
    return out.select(id_col, "term", "_c", "tf", F.log10(F.col("_n") / F.col("_df")).alias("idf"))


def information_gain(words: DataFrame, targets: DataFrame, target_id: str, target_vec: str) -> DataFrame:
    """(term, gain): a word's mean distance to all targets less that to the nearest, from words (term, vector).

    The mean of cosines is one product with the mean of the unit target vectors, so no word meets all targets one by one.
    """
    nearest = nearest_of_each(words, targets, 1, "term", target_id, "vector", target_vec).select(F.col("query_id").alias("term"), F.col("_distance").alias("_least"))
    middle = D.centroid(targets.where(F.col(target_vec).isNotNull()).select(D.normalise(F.col(target_vec)).alias("_m")), "_m")
    mean = words.join(F.broadcast(middle), how="cross").select("term", (1 - D.dot_product(D.normalise(F.col("vector")), F.col("_m"))).alias("_mean"))  # one row
    return mean.join(nearest, "term").select("term", (F.col("_mean") - F.col("_least")).alias("gain"))


def telling_words(scored: DataFrame, gain: DataFrame, id_col: str, gain_percentile: int = 50, tf_idf_percentile: int = 80, most_boost: float = 3.0, least_words: int = 3) -> DataFrame:
    """(id, term, boost, _often) of the words that stand for an object: those among the first gain_percentile hundredths by information
    gain and the first tf_idf_percentile hundredths by tf-idf, or the least_words first ones by gain if they are fewer.

    The word of rank i (from 0) of the first n by gain is boosted by 1 - ln(i / n), most_boost at most; the others count once.
    """
    mine = Window.partitionBy(id_col)
    each = scored.join(gain, "term").select(id_col, "term", "_c", "tf_idf", "gain").withColumn("_often", F.sum("_c").over(Window.partitionBy(id_col, "term")))
    rank = lambda c: F.row_number().over(mine.orderBy(F.desc(c), "term")) - 1
    cut = lambda share: F.floor(F.count(F.lit(1)).over(mine) * share / 100)
    each = each.select("*", rank("gain").alias("_i"), rank("tf_idf").alias("_t"), cut(gain_percentile).alias("_n"), cut(tf_idf_percentile).alias("_m"))
    both = (F.col("_i") < F.col("_n")) & (F.col("_t") < F.col("_m"))
    each = each.withColumn("_both", F.count_if(both).over(mine))
    boost = F.when(F.col("_i") == 0, most_boost).otherwise(F.least(F.lit(float(most_boost)), 1 - F.ln(F.col("_i") / F.col("_n"))))
    kept = each.where(F.when(F.col("_both") < least_words, F.col("_i") < least_words).otherwise(both))
    return kept.select(id_col, "term", F.when(F.col("_i") < F.col("_n"), boost).otherwise(1.0).alias("boost"), "_often")


def contextual(df: DataFrame, targets: DataFrame, id_col: str, tokens: str, words: DataFrame, target_id: str, target_vec: str, **settings) -> DataFrame:
    """Objects by the boosted centroid of their telling words, against target vectors. words: (term, vector); settings as in telling_words."""
    scored = _tf_idf(df, id_col, tokens).withColumn("tf_idf", F.col("tf") * F.col("idf"))
    told = telling_words(scored, information_gain(words, targets, target_id, target_vec), id_col, **settings)
    told = told.join(words, "term").withColumn("_weight", F.col("boost") * F.col("_often"))
    # There are no more objects than rows; counting them by their centroids would do all of this twice.
    return zero_shot(D.centroid(told, "vector", [id_col], "_weight"), targets, id_col, "vector", target_id, target_vec, most=df.count())


def written_back(df: DataFrame, found: DataFrame, id_col: str, column: str, scope: str) -> DataFrame:
    """Labels stored with what they rest on."""
    meta = F.struct(F.lit(scope).alias("scope"), *(F.col(c) for c in found.columns if c not in (id_col, "label")))
    return df.join(found.select(id_col, F.col("label").alias("_label"), meta.alias(f"_{column}_meta")), id_col, "left").withColumn(column, F.coalesce(column, "_label")).drop("_label")
