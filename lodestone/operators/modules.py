"""Extension points: vectorizers by name, with the local bigram family built in; others are registered by their users."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import distance as D

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]+", "")


def _pairs(text: Column, code: Callable[[Column, Column], Column]) -> Column:
    """Codes of adjacent letters, each 0 to 25. The look-ahead takes no letter, so one scan finds all pairs."""
    pairs = F.regexp_extract_all(_letters(text), F.lit("(?=(..))"), 1)
    return F.transform(pairs, lambda p: code(F.ascii(p) - 97, F.ascii(F.substring(p, 2, 1)) - 97))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _counts(codes: Column, size: int) -> Column:
    """Counts of codes 0 to size - 1, divided by their sum: runs of the sorted codes, looked up by code."""
    runs = "array<struct<code:int,n:int>>"

    def step(acc: Column, c: Column) -> Column:
        same, run = acc["code"] == c, F.array(F.struct(acc["code"].alias("code"), acc["n"].alias("n")))
        return F.struct(c.alias("code"), F.when(same, acc["n"] + 1).otherwise(1).alias("n"), F.when(same, acc["out"]).otherwise(F.concat(acc["out"], run)).alias("out"))

    start = F.struct(F.lit(-1).alias("code"), F.lit(0).alias("n"), F.array().cast(runs).alias("out"))
    end = lambda acc: F.map_from_entries(F.concat(acc["out"], F.array(F.struct(acc["code"].alias("code"), acc["n"].alias("n")))))
    spread = lambda counts, n: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at(counts, k), F.lit(0)) / n)
    return _bound(codes, lambda c: _bound(F.aggregate(F.array_sort(c), start, step, end), lambda m: spread(m, F.greatest(F.size(c), F.lit(1)))))


def bigram_alphabet(text: Column) -> Column:
    """676 shares of letter pairs; all else than a to z is dropped first."""
    return _counts(_pairs(text, lambda a, b: a * 26 + b), 676)


def bigram_mod26(text: Column) -> Column:
    """26 shares of letter pairs by their sum of codes modulo 26."""
    return _counts(_pairs(text, lambda a, b: (a + b) % 26), 26)


def bytepairs(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, pair, share) of adjacent bytes: the sparse form of 65,536 dimensions."""
    each = F.regexp_extract_all(F.hex(F.encode(F.lower(text), "utf-8")), F.lit(".."), 0)
    return _sparse(df, id_col, _bound(each, lambda b: F.zip_with(F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))), F.slice(b, 2, F.size(b)), lambda x, y: F.concat(x, y))), "pair")


def trigrams(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, trigram, share) of adjacent letters: the sparse form of 17,576 dimensions."""
    return _sparse(df, id_col, F.regexp_extract_all(_letters(F.col(text)), F.lit("(?=(...))"), 1), "trigram")


def _sparse(df: DataFrame, id_col: str, parts: Column, name: str) -> DataFrame:
    each = df.select(id_col, F.size(parts).alias("_n"), F.explode(parts).alias(name))
    return each.groupBy(id_col, "_n", name).agg(F.count(F.lit(1)).alias("_c")).select(id_col, name, (F.col("_c") / F.col("_n")).alias("share"))


VECTORIZERS: dict[str, Callable[[Column], Column]] = {"bigram": bigram_alphabet, "bigram-mod26": bigram_mod26}


def register(name: str, vectorizer: Callable[[Column], Column]) -> None:
    """Remote or model-backed vectorizers (texts, images, sound) come as functions from a column to a vector column."""
    VECTORIZERS[name] = vectorizer


def vectorize(df: DataFrame, text: str, out: str = "_vector", model: str = "bigram") -> DataFrame:
    if model not in VECTORIZERS:
        raise ValueError(f"vectorizer {model!r} is not configured")
    return df.withColumn(out, VECTORIZERS[model](F.col(text)))


def concept_vector(spark: SparkSession, concepts: list[str], model: str = "bigram", towards: tuple[list[str], float] | None = None, away: tuple[list[str], float] | None = None) -> DataFrame:
    """One row with the mean vector ``_q`` of concepts, moved towards or away from other concepts."""
    if model not in VECTORIZERS:
        raise ValueError(f"vectorizer {model!r} is not configured")

    def mean(words: list[str]) -> Column:
        vectors = [VECTORIZERS[model](F.lit(w)) for w in words]
        total = vectors[0]
        for v in vectors[1:]:
            total = F.zip_with(total, v, lambda a, b: a + b)
        return F.transform(total, lambda x: x / len(words))

    q = mean(concepts)
    if towards:
        q = D.move_to(q, mean(towards[0]), towards[1])
    if away:
        q = D.move_away(q, mean(away[0]), away[1])
    return spark.range(1).select(q.alias("_q"))


def near_text(df: DataFrame, vec: str, concepts: list[str], k: int, id_col: str, model: str = "bigram", towards: tuple[list[str], float] | None = None, away: tuple[list[str], float] | None = None) -> DataFrame:
    """Nearest to the mean vector of concepts, moved towards or away from other concepts."""
    from lodestone.operators.vector import with_distance_to

    return with_distance_to(df, vec, concept_vector(df.sparkSession, concepts, model, towards, away)).orderBy("_distance", id_col).limit(k)


def autocorrect(df: DataFrame, word: str, vocabulary: DataFrame, entry: str, most: int = 2) -> DataFrame:
    """Each word's nearest vocabulary entry within ``most`` edits, ties to the smaller entry.

    An entry is cut into most + 1 segments. So many edits leave one whole, at most that many places away: words probe all of these.
    Segments of entries shorter than that are empty and meet every word of a length near theirs.
    """
    cut = lambda length, i: F.floor(length * i / (most + 1)).cast("int")
    b = vocabulary.select(entry, F.length(entry).alias("_l"), F.explode(F.array(*map(F.lit, range(most + 1)))).alias("_i"))
    b = b.select(entry, "_l", "_i", F.col(entry).substr(cut(F.col("_l"), F.col("_i")) + 1, cut(F.col("_l"), F.col("_i") + 1) - cut(F.col("_l"), F.col("_i"))).alias("_s"))
    a = df.select(word, F.explode(F.sequence(F.greatest(F.lit(0), F.length(word) - most), F.length(word) + most)).alias("_l"))
    a = a.select("*", F.explode(F.array(*map(F.lit, range(most + 1)))).alias("_i"))
    a = a.select("*", F.explode(F.array(*map(F.lit, range(-most, most + 1)))).alias("_d"))
    start = cut(F.col("_l"), F.col("_i")) + F.col("_d")
    a = a.where(start >= 0).select(word, "_l", "_i", F.col(word).substr(start + 1, cut(F.col("_l"), F.col("_i") + 1) - cut(F.col("_l"), F.col("_i"))).alias("_s")).distinct()
    near = a.join(b, ["_l", "_i", "_s"]).select(word, entry).distinct().withColumn("edits", F.levenshtein(word, entry)).where(F.col("edits") <= most)
    return near.groupBy(word).agg(F.min(F.struct("edits", F.col(entry))).alias("_m")).select(word, F.col("_m.edits").alias("edits"), F.col(f"_m.{entry}").alias(entry))
