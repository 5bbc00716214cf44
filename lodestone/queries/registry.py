"""Where queries and their SQL are kept, and what several of them share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Query vectors by a rule, as a list and as SQL.
def vector(n: int = 1) -> list[float]:
    return [((i * 37 * n) % 64) / 64 - 0.5 for i in range(64)]


def vector_sql(n: int = 1) -> str:
    return f"list_transform(range(64), lambda i: ((i * {37 * n}) % 64) / 64.0::DOUBLE - 0.5::DOUBLE)"


def dot_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def cosine_sql(a: str, b: str) -> str:
    return f"greatest(0, 1 - {dot_sql(a, b)} / (sqrt({dot_sql(a, a)}) * sqrt({dot_sql(b, b)})))"


def shown_sql(sql: str, *names: str) -> str:
    """A query's rows with some columns rounded, after whatever ranked them."""
    return f"SELECT * REPLACE ({', '.join(f'round({n}, 6) AS {n}' for n in names)}) FROM ({sql})"


def shown(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share. Only a session on one machine may do without spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root or 'file:///tmp/lodestone-shared'}/lodestone/{uuid.uuid4().hex}"


EMB = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
#: Tokens of a text column by each tokenization, as SQL.
WORDS = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
BLANKS = r"list_filter(regexp_split_to_array({c}, '[\s\x0b\x{{85}}\p{{Z}}]+'), lambda x: x <> '')"


def words_sql(c: str = "text") -> str:
    return WORDS.format(c=c)


def blanks_sql(c: str = "text") -> str:
    return BLANKS.format(c=c)


def letters_sql(text: str) -> str:
    return f"regexp_replace(lower({text}), '[^a-z]+', '', 'g')"


def mod26_sql(text: str) -> str:
    """The 26 shares of letter pairs by their sum modulo 26, as a list."""
    s = letters_sql(text)
    codes = f"list_transform(range(1, length({s})), lambda i: (ascii(substr({s}, i, 1)) + ascii(substr({s}, i + 1, 1)) - 194) % 26)"
    return f"(SELECT list_transform(range(26), lambda k: len(list_filter(w.c, lambda x: x = k)) / greatest(len(w.c), 1)::DOUBLE) FROM (SELECT {codes} AS c) w)"


def concept_sql(concepts: list[str], towards: tuple[list[str], float] | None = None, away: tuple[list[str], float] | None = None) -> str:
    """The mean vector of concepts, moved as near_text moves it."""

    def mean(words: list[str]) -> str:
        vectors = ", ".join(f"{mod26_sql(quote(w))} AS v{i}" for i, w in enumerate(words))
        total = " + ".join(f"n.v{i}[j]" for i in range(len(words)))
        return f"(SELECT list_transform(range(1, 27), lambda j: ({total}) / {len(words)}) FROM (SELECT {vectors}) n)"

    quote = lambda w: f"'{w}'"
    out = mean(concepts)
    if towards:
        out = f"(SELECT list_transform(range(1, 27), lambda j: m.s[j] * {1 - towards[1] / 2}::DOUBLE + m.t[j] * {towards[1] / 2}::DOUBLE) FROM (SELECT {out} AS s, {mean(towards[0])} AS t) m)"
    if away:
        out = f"(SELECT list_transform(range(1, 27), lambda j: m.s[j] + {away[1] / 2}::DOUBLE * (m.s[j] - m.t[j])) FROM (SELECT {out} AS s, {mean(away[0])} AS t) m)"
    return out
