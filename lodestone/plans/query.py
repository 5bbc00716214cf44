"""One call for a whole search or aggregation: filters first, then the search, then what happens to its hits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import distance as D
from lodestone.operators import aggregate as agg
from lodestone.operators import hybrid as hy
from lodestone.operators import keyword, modules, post, vector
from lodestone.operators.filters import Clause, Schema, quoted, where
from lodestone.sources.collection import after, sort

LIMIT = 100
#: What a query may ask of a hit besides its properties.
METADATA = ("id", "vector", "distance", "certainty", "score", "explain_score", "creation_time", "last_update_time")


@dataclass
class NearText:
    """Concepts to search near, and others to move towards or away from with a force."""

    concepts: list[str]
    move_to: tuple[list[str], float] | None = None
    move_away: tuple[list[str], float] | None = None


@dataclass
class Hybrid:
    """A keyword query fused with a vector search. The vector is given, or made of near_text, or of the query itself."""

    query: str | None
    vector: list[float] | None = None
    near_text: NearText | None = None
    alpha: float = hy.ALPHA
    fusion: str = "relative"
    properties: list[str] | None = None
    max_distance: float | None = None

    def __post_init__(self):
        if self.vector is not None and self.near_text is not None:
            raise ValueError("hybrid takes a vector or near_text, not both")


def pruned(column: Column, kind: T.DataType, paths: list[list[str]]) -> Column:
    """A nested value with the named fields only."""
    if any(not p for p in paths):
        return column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: pruned(x, kind.elementType, paths))
    heads = list(dict.fromkeys(p[0] for p in paths))
    return F.when(column.isNotNull(), F.struct(*(pruned(column[h], kind[h].dataType, [p[1:] for p in paths if p[0] == h]).alias(h) for h in heads)))


def selected(df: DataFrame, names: list[str]) -> list[Column]:
    """Properties, or fields of nested ones by their paths (``address.city``), under the names of the properties."""
    heads = list(dict.fromkeys(n.split(".")[0] for n in names))
    return [pruned(F.col(quoted(h)), df.schema[h].dataType, [n.split(".")[1:] for n in names if n.split(".")[0] == h]).alias(h) for h in heads]


@dataclass
class Searchable:
    """A collection's rows with what a search needs to know."""

    df: DataFrame
    id_col: str
    vec: str | None = None
    schema: Schema = field(default_factory=Schema)
    text_props: tuple[str, ...] = ()
    metric: str = "cosine"
    index: str = "hnsw"
    vectorizer: str = "bigram"

    def _near(self, rows: DataFrame, to: list[float] | DataFrame, limit: int | None, distance: float | None, certainty: float | None) -> DataFrame:
        """Rows by their distance to a vector, or to that of a one-row table; a limit below 0 asks for all within a distance,
        none for all."""
        vector.check_indexed(self.index)
        if limit is not None and limit < 0 and distance is None and certainty is None:
            raise ValueError("a search without a limit needs a distance or a certainty")
        if isinstance(to, DataFrame):
            scored = vector.with_distance_to(rows, self.vec, to, self.metric)
        else:
            scored = vector.with_distance(rows.where(F.col(self.vec).isNotNull()), self.vec, to, self.metric)
        if limit is None or limit < 0:
            return vector.keep_certain(scored, certainty, distance)
        return vector.keep_certain(scored.orderBy("_distance", self.id_col).limit(limit), certainty, distance)

    def _concepts(self, n: NearText) -> DataFrame:
        return modules.concept_vector(self.df.sparkSession, n.concepts, self.vectorizer, n.move_to, n.move_away)

    def _keyword(self, query: str, props: list[str] | None, k: int | None, rows: DataFrame | None, explain: bool = False) -> DataFrame:
        return keyword.bm25(self.df, self.id_col, query, list(props or self.text_props), dict(self.schema.tokenization), k, allow=rows, explain=explain, not_searchable=self.schema.not_searchable)

    def _hybrid(self, h: Hybrid, rows: DataFrame, filtered: bool, limit: int) -> DataFrame:
        """(id, score, explain)"""
        k = self._keyword(h.query or "", h.properties, None, rows if filtered else None)
        to = h.vector if h.vector is not None else self._concepts(h.near_text or NearText([h.query]))
        v = self._near(rows, to, None, h.max_distance, None).select(self.id_col, "_distance")
        return hy.hybrid(k, v, self.id_col, h.alpha, h.fusion, limit if limit >= 0 else None, max_distance=h.max_distance)

    def query(
        self, clause: Clause | None = None, near_vector: list[float] | None = None, near_object=None, near_text: NearText | None = None, bm25: str | None = None, hybrid: Hybrid | None = None, sort_by: list[tuple[str, str]] | None = None, limit: int = LIMIT, offset: int = 0, cursor=None, autocut: int | None = None,
        distance: float | None = None, certainty: float | None = None, group_by: dict | None = None, select: list[str] | None = None, metadata: list[str] = (),
    ) -> DataFrame:
        """At most one of near_vector, near_object, near_text, bm25 and hybrid; all else applies to its hits.

        A limit below 0 asks for all rows, for vectors all within a distance.

        select names properties or nested paths, metadata some of METADATA, shown as ``_meta_id``, ``_meta_certainty`` and so on.
        """
        if sum(x is not None for x in (near_vector, near_object, near_text, bm25, hybrid)) > 1:
            raise ValueError("one kind of search at a time")
        if unknown := set(metadata) - set(METADATA):
            raise ValueError(f"no such metadata: {sorted(unknown)}")
        rows, order, wanted = where(self.df, clause, self.schema), [self.id_col], limit + offset if limit >= 0 else limit
        if cursor is not None:
            if clause is not None or sort_by or offset or any(x is not None for x in (near_vector, near_object, near_text, bm25, hybrid)):
                raise ValueError("a cursor goes with no filter, sort, offset or search")
            return self._shown(after(self.df, self.id_col, cursor, limit), select, metadata)
        to = near_vector
        if near_object is not None:
            to = vector.vector_of(self.df, self.vec, near_object, self.id_col)
        if near_text is not None:
            to = self._concepts(near_text)
        if to is not None:
            out, order, score = self._near(rows, to, wanted, distance, certainty), ["_distance", self.id_col], "_distance"
        elif bm25 is not None or hybrid is not None:
            filtered = clause is not None
            hits = self._keyword(bm25, None, wanted if wanted >= 0 else None, rows if filtered else None, "explain_score" in metadata) if bm25 is not None else self._hybrid(hybrid, rows, filtered, wanted)
            tie = self.id_col if bm25 is not None else F.desc(self.id_col)
            out, order, score = hits.join(rows, self.id_col), [F.desc("score"), tie], "score"
        else:
            return self._shown(sort(rows, sort_by or [], self.id_col, limit if limit >= 0 else None, offset), select, metadata)
        if autocut:
            out = post.autocut(out, score, order, autocut)
        if group_by:
            return post.group_by(out, group_by["property"], order, group_by["groups"], group_by["per_group"], isinstance(out.schema[group_by["property"]].dataType, T.ArrayType))
        out = sort(out, sort_by, self.id_col) if sort_by else out.orderBy(*order)
        return self._shown(out.offset(offset), select, metadata)

    def _shown(self, df: DataFrame, select: list[str] | None, metadata: list[str] = ()) -> DataFrame:
        has = lambda c: F.col(c) if c in df.columns else F.lit(None)
        meta = {
            "id": F.col(self.id_col).cast("string"), "vector": has(self.vec) if self.vec else F.lit(None), "distance": has("_distance").cast("double"), "certainty": D.certainty(has("_distance").cast("double")) if self.metric == "cosine" else F.lit(None).cast("double"),
            "score": has("score").cast("double"), "explain_score": F.to_json(F.struct(has("explain").alias("explain"))), "creation_time": has("_creationTime"), "last_update_time": has("_updateTime"),
        }
        more = [meta[m].alias(f"_meta_{m}") for m in metadata]
        if select is None:
            return df.select("*", *more) if more else df
        plain = [] if self.id_col in [n.split(".")[0] for n in select] else [self.id_col]
        return df.select(*plain, *selected(df, select), *(c for c in ("_distance", "score") if c in df.columns and c not in select), *more)

    def aggregate(self, props: dict[str, str] | None = None, clause: Clause | None = None, group_by: str | None = None, near_vector: list[float] | None = None, near_text: NearText | None = None, bm25: str | None = None, hybrid: Hybrid | None = None, object_limit: int | None = None, certainty: float | None = None, limit: int = agg.GROUP_LIMIT) -> DataFrame:
        """Aggregations over all rows, or over the hits of one search, which needs an object limit (or, near vectors, a certainty)."""
        rows = where(self.df, clause, self.schema)
        asked = [x for x in (near_vector, near_text, bm25, hybrid) if x is not None]
        if len(asked) > 1:
            raise ValueError("one kind of search at a time")
        if asked and object_limit is None and (certainty is None or bm25 is not None or hybrid is not None):
            raise ValueError("a search to aggregate over needs an object limit or a certainty")
        if near_vector is not None or near_text is not None:
            to = near_vector if near_vector is not None else self._concepts(near_text)
            rows = self._near(rows, to, object_limit if object_limit is not None else -1, None, certainty)
        elif asked:
            filtered = clause is not None
            hits = self._keyword(bm25, None, object_limit, rows if filtered else None) if bm25 is not None else self._hybrid(hybrid, rows, filtered, object_limit)
            rows = rows.join(hits.select(self.id_col), self.id_col, "left_semi")
        return agg.aggregate(rows, props, group_by, limit)
