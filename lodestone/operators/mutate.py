"""Mutations as transformations: each takes the rows that are there and gives the rows that are there afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of_each(batch: DataFrame, id_col: str, order: str) -> DataFrame:
    """Of rows with equal ids the last counts."""
    return batch.withColumn("_r", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def put(current: DataFrame, batch: DataFrame, id_col: str, order: str | None = None, updated: str | None = None) -> DataFrame:
    """Insert or replace whole objects. Of rows with equal ids the last by ``order`` counts, or the last of the batch's own order.

    updated: the column of update times; an object that is put as it is already, apart from that column, keeps the old time.
    """
    new = last_of_each(batch, id_col, order) if order else last_of_each(batch.withColumn("_place", F.monotonically_increasing_id()), id_col, "_place")
    new = new.select(current.columns)
    if updated:
        rest = [c for c in current.columns if c not in (id_col, updated)]
        old = current.select(id_col, F.struct(*rest).alias("_old"), F.col(updated).alias("_time"))
        same = F.struct(*rest).eqNullSafe(F.col("_old"))
        new = new.join(old, id_col, "left").withColumn(updated, F.when(same, F.col("_time")).otherwise(F.col(updated))).select(current.columns)
    return current.join(new.select(id_col), id_col, "left_anti").select(current.columns).unionByName(new)


def put_report(batch: DataFrame, id_col: str, order: str, error: Column) -> DataFrame:
    """Each object of a batch with its error, if any, and whether it is the one that stays."""
    last = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(order))) == 1
    return batch.select(id_col, order, error.alias("error")).withColumn("stays", last & F.col("error").isNull())


def update(current: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """Replace objects that exist; others are left out."""
    known = new.join(current.select(id_col), id_col, "left_semi")
    return put(current, known, id_col)


def patch(current: DataFrame, changes: DataFrame, id_col: str, props: list[str], refs: list[str] = (), cleared: str | None = None) -> DataFrame:
    """Overwrite given properties, append references, clear those named in the array column ``cleared``; the rest stays."""
    named = [F.col(c).alias(f"_new_{c}") for c in (*props, *refs)] + ([F.col(cleared).alias("_cleared")] if cleared else [])
    df = current.join(changes.select(id_col, *named), id_col, "left")
    cols = {}
    for p in props:
        new = F.coalesce(f"_new_{p}", p)
        cols[p] = F.when(F.array_contains("_cleared", p), None).otherwise(new) if cleared else new
    for r in refs:
        cols[r] = F.when(F.col(f"_new_{r}").isNotNull(), F.concat(F.coalesce(r, F.array().cast(current.schema[r].dataType)), f"_new_{r}")).otherwise(F.col(r))
    return df.withColumns(cols).select(current.columns)


def delete(current: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return current.join(ids.select(id_col), id_col, "left_anti").select(current.columns)


def delete_where(current: DataFrame, predicate: Column, id_col: str, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows left, report of matched ids). A dry run leaves all."""
    hit = F.coalesce(predicate, F.lit(False))
    report = current.where(hit).select(id_col, F.lit("DRYRUN" if dry_run else "SUCCESS").alias("status"))
    return (current if dry_run else current.where(~hit)), report


def delete_counts(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("status") == "SUCCESS").alias("successful"), F.count_if(F.col("status") == "FAILED").alias("failed"))


def add_references(current: DataFrame, edges: DataFrame, id_col: str, refs: str, source: str = "from_id", target: str = "to_id", order: str | None = None) -> DataFrame:
    """Append a batch of (from, to) edges to the arrays of their sources, in their order."""
    lists = edges.groupBy(F.col(source).alias(id_col)).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order or target).alias("o"), F.col(target).alias("t")))), lambda s: s["t"]).alias("_more"))
    more = F.when(F.col("_more").isNotNull(), F.concat(F.coalesce(refs, F.array().cast(current.schema[refs].dataType)), "_more")).otherwise(F.col(refs))
    return current.join(lists, id_col, "left").withColumn(refs, more).select(current.columns)


def replace_references(df: DataFrame, refs: str, new: Column, on: Column) -> DataFrame:
    return df.withColumn(refs, F.when(on, new).otherwise(F.col(refs)))


def delete_references(df: DataFrame, refs: str, gone: Column, on: Column) -> DataFrame:
    return df.withColumn(refs, F.when(on, F.array_except(refs, gone)).otherwise(F.col(refs)))


def newest_replica(replicas: list[DataFrame], id_col: str, updated: str, need: int | None = None) -> DataFrame:
    """The newest version of each object over replicas; with ``need``, only objects that so many replicas hold."""
    from functools import reduce

    every = reduce(lambda a, b: a.unionByName(b), (r.withColumn("_replica", F.lit(i)) for i, r in enumerate(replicas)))
    cols = [c for c in replicas[0].columns if c != id_col]
    out = every.groupBy(id_col).agg(F.max_by(F.struct(*cols), F.struct(updated, -F.col("_replica"))).alias("_v"), F.count_distinct("_replica").alias("_n"))
    return out.where(F.col("_n") >= (need or 1)).select(id_col, "_v.*")


def shard_of(id_col: str, n: int) -> Column:
    """The shard of an object: the first 32 bits of its id's MD5, modulo n."""
    return F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % n


def shards(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """Objects of each of n hash-routed shards."""
    return df.groupBy(shard_of(id_col, n).alias("shard")).agg(F.count(F.lit(1)).alias("objects"))
