"""Collections: declared schemas, inference from rows, validation, a catalog with aliases and tenants, snapshots."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
RFC3339 = re.compile(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)$")
GEO = T.StructType([T.StructField("latitude", T.FloatType()), T.StructField("longitude", T.FloatType())])
PHONE = T.StructType([T.StructField(n, t()) for n, t in (("input", T.StringType), ("internationalFormatted", T.StringType), ("nationalFormatted", T.StringType), ("national", T.LongType), ("countryCode", T.LongType), ("defaultCountry", T.StringType), ("valid", T.BooleanType))])
SPARK_TYPE = {"text": T.StringType(), "int": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "date": T.TimestampType(), "uuid": T.StringType(), "geoCoordinates": GEO, "phoneNumber": PHONE, "blob": T.BinaryType()}


@dataclass
class Property:
    name: str
    data_type: str
    tokenization: str = "word"
    filterable: bool = True
    searchable: bool = True
    range_filters: bool = False
    nested: list[Property] = field(default_factory=list)

    def spark_type(self) -> T.DataType:
        base = self.data_type.removesuffix("[]")
        inner = T.StructType([T.StructField(p.name, p.spark_type()) for p in self.nested]) if base == "object" else SPARK_TYPE[base]
        return T.ArrayType(inner) if self.data_type.endswith("[]") else inner


@dataclass
class Collection:
    name: str
    properties: list[Property]
    vectors: dict[str, str] = field(default_factory=lambda: {"": "hnsw"})
    multi_tenant: bool = False

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(p.name, p.spark_type(), True, {"tokenization": p.tokenization}) for p in self.properties])

    def add(self, p: Property) -> None:
        if any(q.name == p.name for q in self.properties):
            raise ValueError(f"{p.name} is there already")
        self.properties.append(p)


def infer(value, number: str = "number") -> str:
    """The data type of a JSON value."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return number
    if isinstance(value, str):
        return "date" if RFC3339.match(value) else "uuid" if UUID.match(value) else "text"
    if isinstance(value, dict):
        if set(value) == {"latitude", "longitude"}:
            return "geoCoordinates"
        return "phoneNumber" if "input" in value and set(value) <= {f.name for f in PHONE} else "object"
    if isinstance(value, list):
        kinds = {infer(v, number) for v in value}
        if not kinds or kinds <= {"text", "uuid", "date"} and len(kinds) > 1:
            return "text[]"
        if len(kinds) > 1:
            raise ValueError(f"elements of different types: {sorted(kinds)}")
        return kinds.pop() + "[]"
    raise ValueError(f"no data type for {value!r}")


def infer_properties(row: dict, number: str = "number") -> list[Property]:
    out = []
    for k, v in row.items():
        if v is not None:
            kind = infer(v, number)
            first = v[0] if isinstance(v, list) and v else v
            out.append(Property(k, kind, nested=infer_properties(first, number) if kind.startswith("object") else []))
    return out


def validate(row: dict, collection: Collection) -> list[str]:
    """What keeps an object from being stored."""
    known, errors = {p.name: p for p in collection.properties}, []
    for k, v in row.items():
        if k not in known:
            errors.append(f"no such property: {k}")
        elif v is not None:
            want, got = known[k].data_type, infer(v, "int" if isinstance(v, int) else "number")
            fits = got == want or (want == "number" and got == "int") or (want.removesuffix("[]") == "text" and got.removesuffix("[]") in ("uuid", "date")) or want == "blob" and got == "text" or v == []
            if not fits:
                errors.append(f"{k}: {got} where {want} is declared")
    return errors


#: JSON kinds by the name of a variant's type, before a value's text is looked at.
KINDS = {"BIGINT": "int", "DOUBLE": "number", "DECIMAL": "number", "STRING": "text", "BOOLEAN": "boolean", "OBJECT": "object", "VOID": "null"}


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def kind_of(value: Column) -> Column:
    """The data type of a JSON value (a variant column) by the rules of ``infer``: "text", "int[]" and so on; null for null."""
    return bound(value, lambda v: bound(F.schema_of_variant(v), lambda name: _kind(v, name)))


def _kind(value: Column, name: Column) -> Column:
    plain = lambda n: F.coalesce(*(F.when(n.startswith(k), F.lit(v)) for k, v in KINDS.items()))
    text_kind = lambda s: F.when(s.rlike(RFC3339.pattern), "date").when(s.rlike(UUID.pattern), "uuid").otherwise("text")
    text = bound(F.try_variant_get(value, "$", "string"), text_kind)

    def some_kind(fields: Column) -> Column:
        geo = (F.size(fields) == 2) & F.array_contains(fields, "latitude") & F.array_contains(fields, "longitude")
        phone = F.array_contains(fields, "input") & (F.size(F.array_except(fields, F.array(*(F.lit(f.name) for f in PHONE)))) == 0)
        return F.when(geo, "geoCoordinates").when(phone, "phoneNumber").otherwise("object")

    some = bound(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), some_kind)
    many = F.try_variant_get(value, "$", "array<variant>")
    each = F.array_distinct(F.transform(F.try_variant_get(value, "$", "array<string>"), text_kind))
    texts = bound(each, lambda e: F.when(F.size(e) == 1, F.concat(e[0], F.lit("[]"))).otherwise("text[]"))
    kinds = lambda inner: F.when(F.size(many) == 0, "text[]").when(inner.startswith("STRING"), texts).when(inner.startswith("VARIANT"), "mixed[]").otherwise(F.concat(plain(inner), F.lit("[]")))
    listed = bound(F.regexp_extract(name, "^ARRAY<(.*)>$", 1), kinds)
    return F.when(name.startswith("ARRAY"), listed).when(name.startswith("STRING"), text).when(name.startswith("OBJECT"), some).when(name != "VOID", plain(name))


def validated(df: DataFrame, objects: str, collection: Collection) -> DataFrame:
    """df with ``_errors``: what keeps the JSON object in a column from being stored, by the rules of ``validate``, as column expressions."""
    unknown = F.array_except(F.json_object_keys(objects), F.array(*(F.lit(p.name) for p in collection.properties)).cast("array<string>"))
    none = F.array().cast("array<string>")

    def misfit(p: Property, one: Column, got: Column) -> Column:
        want = p.data_type
        fits = got == want
        if want in ("number", "number[]"):
            fits = fits | (got == want.replace("number", "int"))
        if want in ("text", "text[]"):
            fits = fits | got.isin(*(k + want[4:] for k in ("uuid", "date")))
        if want.endswith("[]"):
            fits = fits | (F.size(F.try_variant_get(one, "$", "array<variant>")) == 0)
        if want == "blob":
            fits = fits | (got == "text")
        return F.when(~fits, F.array(F.concat(F.lit(f"{p.name}: "), got, F.lit(f" where {want} is declared")))).otherwise(none)

    def checked(value: Column, p: Property) -> Column:
        return bound(F.try_variant_get(value, f"$.{p.name}", "variant"), lambda one: bound(kind_of(one), lambda got: misfit(p, one, got)))

    def found(value: Column) -> Column:
        errors = [F.transform(F.array_sort(unknown), lambda k: F.concat(F.lit("no such property: "), k))]
        errors += [checked(value, p) for p in collection.properties]
        return F.when(value.isNull(), F.array(F.lit("not a JSON object"))).otherwise(F.concat(*(F.coalesce(e, none) for e in errors)))

    # The object is parsed once, and so is what is asked of each property.
    return df.withColumn("_errors", bound(F.try_parse_json(objects), found))


def inferred(df: DataFrame, objects: str) -> DataFrame:
    """(name, data_type) of all properties that the JSON objects of a column have: one pass, one row for each name and kind moved.

    Whole and other numbers together are numbers; texts, dates and ids together are texts; else kinds that differ are an error.
    """
    value = F.try_parse_json(objects)
    each = df.select(F.explode(F.try_variant_get(value, "$", "map<string,variant>")).alias("name", "v")).select("name", kind_of(F.col("v")).alias("kind")).where("kind is not null")
    kinds = each.groupBy("name").agg(F.array_sort(F.collect_set("kind")).alias("k"))
    among = lambda *names: F.size(F.array_except("k", F.array(*map(F.lit, names)))) == 0
    merged = F.when(F.size("k") == 1, F.col("k")[0]).when(among("int", "number"), "number").when(among("int[]", "number[]"), "number[]").when(among("text", "uuid", "date"), "text").when(among("text[]", "uuid[]", "date[]"), "text[]")
    return kinds.select("name", F.coalesce(merged, F.concat(F.lit("conflict: "), F.array_join("k", ", "))).alias("data_type"))


class Catalog:
    """Collections and aliases of one session; each collection's rows are a DataFrame."""

    HOT, COLD, OFFLOADED = "HOT", "COLD", "OFFLOADED"

    def __init__(self, spark: SparkSession):
        self.spark, self.collections, self.rows, self.aliases, self.tenants = spark, {}, {}, {}, {}

    def create(self, c: Collection, rows: DataFrame | None = None) -> None:
        if c.name in self.collections or c.name in self.aliases:
            raise ValueError(f"{c.name} is taken")
        self.collections[c.name] = c
        self.rows[c.name] = rows if rows is not None else self.spark.createDataFrame([], c.schema())

    def add_property(self, name: str, p: Property) -> None:
        """Declare a further property; rows that are there have none."""
        name = self.resolve(name)
        self.collections[name].add(p)
        self.rows[name] = self.rows[name].withColumn(p.name, F.lit(None).cast(p.spark_type()))

    def drop(self, name: str) -> None:
        self.collections.pop(name)
        self.rows.pop(name)
        self.aliases = {a: n for a, n in self.aliases.items() if n != name}

    def resolve(self, name: str) -> str:
        name = self.aliases.get(name, name)
        if name not in self.collections:
            raise ValueError(f"no such collection: {name}")
        return name

    def alias(self, alias: str, name: str) -> None:
        self.aliases[alias] = self.resolve(name)

    def read(self, name: str, tenant: str | None = None) -> DataFrame:
        name = self.resolve(name)
        if not self.collections[name].multi_tenant:
            return self.rows[name]
        state = self.tenants.get((name, tenant))
        if state != self.HOT:
            raise ValueError(f"tenant {tenant!r} is {state or 'unknown'}")
        return self.rows[name].where(F.col("_tenant") == tenant)

    def set_tenant(self, name: str, tenant: str, state: str = HOT) -> None:
        self.tenants[(self.resolve(name), tenant)] = state

    def drop_tenant(self, name: str, tenant: str) -> None:
        name = self.resolve(name)
        self.tenants.pop((name, tenant))
        self.rows[name] = self.rows[name].where(F.col("_tenant") != tenant)

    def find(self, object_id, id_cols: dict[str, str]) -> DataFrame:
        """An id over all collections: (class, id)."""
        from functools import reduce

        return reduce(lambda a, b: a.union(b), (self.rows[n].where(F.col(c) == object_id).select(F.lit(n).alias("class"), F.col(c).cast("string").alias("id")) for n, c in id_cols.items()))

    def backup(self, path: str, include: list[str] | None = None, exclude: list[str] = ()) -> list[str]:
        """Write the rows of all collections, or of some, to a folder; gives their names."""
        names = [n for n in (include or self.rows) if n not in exclude]
        for n in names:
            self.rows[self.resolve(n)].write.mode("overwrite").parquet(f"{path}/{self.resolve(n)}")
        return names

    def restore(self, path: str, include: list[str] | None = None) -> None:
        for n in include or self.collections:
            self.rows[self.resolve(n)] = self.spark.read.parquet(f"{path}/{self.resolve(n)}")


def after(df: DataFrame, id_col: str, last, n: int) -> DataFrame:
    """The next rows of a cursor scan."""
    return df.where(F.col(id_col) > last).orderBy(id_col).limit(n)


SORT_LOWER = (T.StringType,)


def sort(df: DataFrame, keys: list[tuple[str, str]], id_col: str, limit: int | None = None, offset: int = 0, maximum: int = 10_000) -> DataFrame:
    """Rows by several keys: text without regard to case, missing values smallest, ties by id."""
    if limit is not None and limit + offset > maximum:
        raise ValueError(f"limit and offset reach beyond {maximum}")
    cols = []
    for name, way in keys:
        kind = df.schema[name].dataType
        folded = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, SORT_LOWER)
        c = F.transform(name, F.lower) if folded else F.lower(name) if isinstance(kind, SORT_LOWER) else F.col(name)
        cols.append(c.asc_nulls_first() if way == "asc" else c.desc_nulls_last())
    out = df.orderBy(*cols, id_col).offset(offset)
    return out.limit(limit) if limit is not None else out
