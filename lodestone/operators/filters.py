"""Filter clauses: a small algebra of predicates over rows.

Negations are complements over all rows, also those with missing values. So below a negation predicates are two-valued
columns; elsewhere null stands for false and they stay bare, which lets comparisons reach the scan (``PushedFilters``).
Clauses on reference paths become semi joins before the rest is applied.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as tx
from lodestone.functions.distance import haversine


class OnlyStopwordsError(ValueError):
    """A text operand had nothing but stop-words."""


@dataclass(frozen=True)
class Schema:
    """What filters need to know of properties: tokenization, and which may be filtered or searched by what."""

    tokenization: dict[str, str] = field(default_factory=dict)
    not_filterable: frozenset[str] = frozenset()
    not_searchable: frozenset[str] = frozenset()
    null_state: bool = True
    property_length: bool = True
    timestamps: bool = True
    stopwords: tuple[str, ...] = tuple(tx.STOPWORDS["en"])


@dataclass(frozen=True)
class Ref:
    """A reference path: rows whose ``column`` (a key or array of keys) points to a row of ``target`` that meets ``where``."""

    column: str
    target: DataFrame
    key: str
    where: object = None
    schema: Schema = Schema()


@dataclass(frozen=True)
class Clause:
    op: str
    prop: str | None = None
    value: object = None
    children: tuple = ()
    ref: Ref | None = None

    def __and__(self, other: Clause) -> Clause:
        return Clause("And", children=(self, other))

    def __or__(self, other: Clause) -> Clause:
        return Clause("Or", children=(self, other))

    def __invert__(self) -> Clause:
        return Clause("Not", children=(self,))


class Prop:
    """``prop("n_chars") > 5`` and so on."""

    def __init__(self, name: str):
        self.name = name

    def equal(self, v) -> Clause:
        return Clause("Equal", self.name, v)

    def not_equal(self, v) -> Clause:
        return Clause("NotEqual", self.name, v)

    __eq__ = equal
    __ne__ = not_equal
    __hash__ = None

    def __gt__(self, v) -> Clause:
        return Clause("GreaterThan", self.name, v)

    def __ge__(self, v) -> Clause:
        return Clause("GreaterThanEqual", self.name, v)

    def __lt__(self, v) -> Clause:
        return Clause("LessThan", self.name, v)

    def __le__(self, v) -> Clause:
        return Clause("LessThanEqual", self.name, v)

    def like(self, pattern: str) -> Clause:
        return Clause("Like", self.name, pattern)

    def is_null(self, null: bool = True) -> Clause:
        return Clause("IsNull", self.name, null)

    def contains_any(self, *v) -> Clause:
        return Clause("ContainsAny", self.name, v)

    def contains_all(self, *v) -> Clause:
        return Clause("ContainsAll", self.name, v)

    def contains_none(self, *v) -> Clause:
        return Clause("ContainsNone", self.name, v)

    def within(self, lat: float, lon: float, metres: float) -> Clause:
        return Clause("WithinGeoRange", self.name, (lat, lon, metres))


def prop(name: str) -> Prop:
    return Prop(name)


def points_to(ref: Ref) -> Clause:
    return Clause("Ref", ref=ref)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def like_regex(token: str) -> str:
    """? is one character, * any run; all else is literal."""
    return "(?s)^" + "".join("." if ch == "?" else ".*" if ch == "*" else re.escape(ch) for ch in token) + "$"


COMPARE = {"GreaterThan": "__gt__", "GreaterThanEqual": "__ge__", "LessThan": "__lt__", "LessThanEqual": "__le__", "Equal": "__eq__", "NotEqual": "__ne__"}


class Planner:
    """Turns clauses into columns for one DataFrame and schema."""

    def __init__(self, df: DataFrame, schema: Schema = Schema()):
        self.df, self.schema, self.two_valued = df, schema, True

    def _true(self, c: Column) -> Column:
        return true(c) if self.two_valued else c

    def bare(self, c: Clause) -> Column:
        """The clause as a column that may be null for false."""
        self.two_valued = False
        out = self.column(c)
        self.two_valued = True
        return out

    def _complement(self, make) -> Column:
        before, self.two_valued = self.two_valued, True
        out = ~make()
        self.two_valued = before
        return out

    def _type(self, name: str) -> T.DataType:
        """The type of a property, or of a nested one by its path (``address.city``)."""
        top, *inner = name.split(".")
        if top not in self.df.columns:
            raise ValueError(f"no such property: {name}")
        if name in self.schema.not_filterable and name in self.schema.not_searchable:
            raise ValueError(f"{name} has no index to filter by")
        kind = self.df.schema[top].dataType
        for part in inner:
            several = isinstance(kind, T.ArrayType)
            kind = kind.elementType if several else kind
            if not isinstance(kind, T.StructType) or part not in kind.names:
                raise ValueError(f"no such property: {name}")
            kind = T.ArrayType(kind[part].dataType) if several else kind[part].dataType
        return kind

    def _query_terms(self, name: str, value: str) -> list[str]:
        how = self.schema.tokenization.get(name, "word")
        terms = tx.query_tokens(value, how)
        if how == "word":
            kept = [t for t in terms if t not in self.schema.stopwords]
            if terms and not kept:
                raise OnlyStopwordsError(value)
            terms = kept
        return terms

    def _tokens(self, name: str, kind: T.DataType) -> Column:
        how = self.schema.tokenization.get(name, "word")
        if isinstance(kind, T.ArrayType):
            return F.flatten(F.transform(F.col(name), lambda x: tx.TOKENIZERS[how](x)))
        return tx.tokens(name, how)

    def _is_text(self, kind: T.DataType) -> bool:
        return isinstance(kind.elementType if isinstance(kind, T.ArrayType) else kind, T.StringType)

    def _compare(self, op: str, name: str, value) -> Column:
        if m := re.fullmatch(r"len\((\w+)\)", name):
            if not self.schema.property_length:
                raise ValueError("property lengths are not indexed")
            kind = self._type(m[1])
            size = F.size(m[1]) if isinstance(kind, T.ArrayType) else F.char_length(F.col(m[1]))
            return getattr(F.coalesce(F.when(F.col(m[1]).isNull(), 0).otherwise(size), F.lit(0)), COMPARE[op])(value)
        kind = self._type(name)
        if name in ("_creationTime", "_updateTime") and not self.schema.timestamps:
            raise ValueError("timestamps are not indexed")
        how = self.schema.tokenization.get(name, "word")
        if op == "Equal" and self._is_text(kind) and how == "field" and not isinstance(kind, T.ArrayType):
            return self._equal_field(name, str(value))
        if op == "Equal" and self._is_text(kind) and how != "id":
            have = self._tokens(name, kind)
            return reduce(lambda a, b: a & b, (self._true(F.array_contains(have, t)) for t in self._query_terms(name, value)), F.lit(True))
        if how == "id" and isinstance(value, str):
            value = tx.plain_id(value)
        if isinstance(kind, T.ArrayType):
            return self._true(F.exists(name, lambda x: getattr(x, COMPARE[op])(F.lit(value))))
        return self._true(getattr(F.col(name), COMPARE[op])(F.lit(value)))

    def _equal_field(self, name: str, value: str) -> Column:
        """Equality of a whole trimmed value. Such a value begins with what is asked for, or with a blank; all blanks are either
        smaller than '!' or not smaller than U+0085. The scan can test that."""
        c, v = F.col(name), value.strip(tx.WHITE)
        exact = tx.trimmed(c) == v
        if not v:
            return self._true(exact)
        return self._true((c.startswith(v) | (c < "!") | (c >= "\x85")) & exact)

    def column(self, c: Clause) -> Column:
        if c.op in ("And", "Or"):
            if not c.children:
                raise ValueError(f"{c.op} needs operands")
            parts = [self.column(x) for x in c.children]
            return reduce(lambda a, b: a & b if c.op == "And" else a | b, parts)
        if c.op == "Not":
            if len(c.children) != 1:
                raise ValueError("Not needs exactly one operand")
            return self._complement(lambda: self.column(c.children[0]))
        if c.op == "Ref":
            return F.col(self._lifted(c))
        if c.op == "NotEqual":
            kind, how = self._type(c.prop) if not c.prop.startswith("len(") else None, self.schema.tokenization.get(c.prop, "word")
            if kind is not None and self._is_text(kind) and how not in ("id", "field"):
                have = self._tokens(c.prop, kind)
                return reduce(lambda a, b: a & b, (~true(F.array_contains(have, t)) for t in self._query_terms(c.prop, c.value)), F.lit(True))
            if kind is not None and not self._is_text(kind) and not isinstance(kind, T.ArrayType):
                return F.col(c.prop).isNull() | (F.col(c.prop) != F.lit(c.value))
            return self._complement(lambda: self._compare("Equal", c.prop, c.value))
        if c.op == "IsNull":
            if not self.schema.null_state:
                raise ValueError("null states are not indexed")
            kind, col = self._type(c.prop), F.col(c.prop)
            null = col.isNull()
            if isinstance(kind, T.ArrayType):
                null = null | true(F.size(col) == 0)
            elif isinstance(kind, T.StringType):
                null = null | true(F.length(col) == 0)
            return null if c.value else ~null
        if c.op == "Like":
            kind = self._type(c.prop)
            how = self.schema.tokenization.get(c.prop, "word")
            if how == "field" and re.fullmatch(r"[^?*]*\*", c.value):
                return self._true(tx.trimmed(F.col(c.prop)).startswith(c.value[:-1]))
            have = self._tokens(c.prop, kind)
            parts = tx.wildcard_tokens(c.value, how) if how != "field" else [c.value]
            return reduce(lambda a, b: a & b, (self._true(matches_any(have, like_regex(t))) for t in parts))
        if c.op in ("ContainsAny", "ContainsAll", "ContainsNone"):

            def joined() -> Column:
                parts = []
                for v in c.value:
                    try:
                        parts.append(self._compare("Equal", c.prop, v))
                    except OnlyStopwordsError:
                        if c.op == "ContainsAll":
                            raise
                if not parts:
                    raise OnlyStopwordsError(str(c.value))
                return reduce(lambda a, b: a & b if c.op == "ContainsAll" else a | b, parts)

            return self._complement(joined) if c.op == "ContainsNone" else joined()
        if c.op == "WithinGeoRange":
            lat, lon, metres = c.value
            at = F.col(c.prop)
            return self._true(haversine(at["latitude"].cast("double"), at["longitude"].cast("double"), F.lit(float(lat)), F.lit(float(lon))) <= metres)
        return self._compare(c.op, c.prop, c.value)

    def _lifted(self, c: Clause) -> str:
        """Join a reference clause's truth to every row: keys that the inner filter keeps, met by an equi-join."""
        r, name = c.ref, f"_ref{id(c.ref)}"
        if name in self.df.columns:
            return name
        inner = where(r.target, r.where, r.schema) if r.where is not None else r.target
        keys = inner.select(F.col(r.key).alias("_k")).distinct()
        if isinstance(self.df.schema[r.column].dataType, T.ArrayType):
            # Rows meet their hits again by a digest of the keys; numbers may differ when rows are computed again.
            rows = self.df.withColumn("_row", F.unhex(F.sha2(F.to_json(F.struct(F.col(r.column).alias("k"))), 256)))
            hits = rows.select("_row", r.column).dropDuplicates(["_row"]).select("_row", F.explode(r.column).alias("_k")).join(keys, "_k", "left_semi").select("_row").distinct().withColumn(name, F.lit(True))
            self.df = rows.join(hits, "_row", "left").withColumn(name, true(F.col(name))).drop("_row")
        else:
            self.df = self.df.join(keys.withColumn(name, F.lit(True)), F.col(r.column) == F.col("_k"), "left").drop("_k").withColumn(name, true(F.col(name)))
        return name


def matches_any(tokens: Column, pattern: str) -> Column:
    return F.exists(tokens, lambda t: t.rlike(pattern))


def where(df: DataFrame, clause: Clause | None, schema: Schema = Schema()) -> DataFrame:
    """Rows of df that meet the clause; plain reference conjuncts run as semi joins."""
    if clause is None:
        return df
    conjuncts, rest = [clause], []
    while conjuncts:
        c = conjuncts.pop()
        if c.op == "And" and c.children:
            conjuncts += c.children
        else:
            rest.append(c)
    names = df.columns
    for c in [c for c in rest if c.op == "Ref"]:
        inner = where(c.ref.target, c.ref.where, c.ref.schema).select(F.col(c.ref.key).alias("_k"))
        on = F.array_contains(c.ref.column, F.col("_k")) if isinstance(df.schema[c.ref.column].dataType, T.ArrayType) else F.col(c.ref.column) == F.col("_k")
        if isinstance(df.schema[c.ref.column].dataType, T.ArrayType):
            p = Planner(df, schema)
            p._lifted(c)
            df = p.df.where(F.col(f"_ref{id(c.ref)}")).select(*map(quoted, names))
        else:
            df = df.join(inner, on, "left_semi")
    plan = Planner(df, schema)
    columns = [plan.bare(c) for c in rest if c.op != "Ref"]
    if not columns:
        return df
    return plan.df.where(reduce(lambda a, b: a & b, columns)).select(*map(quoted, names))
