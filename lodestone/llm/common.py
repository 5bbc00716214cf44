"""What the operators of this subpackage share: the shared folder, written tables, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only a session on one machine may do without."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "lodestone-shared")
    return path.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    path = f"{shared_dir(df.sparkSession)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` from which all that is needed has been written."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remainder(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the split between learning and held-out rows."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent rows (h, c), as many as come to ``most`` at most, by a threshold on counts.

    The threshold comes from a histogram of logarithms, a table of bounded size; no row is ranked.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    bins = counts.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("b")).collect()  # 1,024 rows at most
    total, least = 0, None
    for r in bins:
        total += r.n
        if total > most:
            break
        least = r.b
    return counts.where(step >= least) if least is not None else counts.limit(0)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: (node, comp), comp the smallest node reachable. Nodes without edges are absent.

    Alternating large-star and small-star contraction: every round is two aggregations and two joins on node ids,
    no node's neighbours are ever gathered in one place, and the rounds grow with the logarithm of the diameter. Each round is
    written once, and the round before it deleted.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = written(e, "edges")
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = written(small.where("u <> v").distinct(), "edges")
        discard(e)
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        e, seen = new, now
    pairs = new.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return pairs.union(pairs.select(F.col("comp").alias("node"), "comp").distinct())
