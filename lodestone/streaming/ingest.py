"""Streams into collections: upserts by micro-batch, and filters or windowed counts over what arrives."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.filters import Clause, Schema, where
from lodestone.operators.mutate import put


BUCKETS = 64


def current(spark: SparkSession, path: str, epoch: int | None = None) -> DataFrame:
    """The collection that ``upsert`` keeps, after its last batch or after a given one."""
    heads = spark.read.parquet(f"{path}/heads")
    heads = heads.where(F.col("epoch") <= epoch) if epoch is not None else heads
    newest = heads.groupBy("bucket").agg(F.max("epoch").alias("epoch")).collect()  # a row for each bucket
    return spark.read.parquet(*sorted(f"{path}/epoch={r.epoch}/_bucket={r.bucket}" for r in newest))


def upsert(stream: DataFrame, path: str, id_col: str, order: str, checkpoint: str, once: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Each micro-batch replaces objects of equal ids. Rows live in hash buckets; a batch rewrites only the buckets that it touches.

    A batch writes its buckets under its own number and then their names, so a batch done again writes the same.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        spark, names = df.sparkSession, df.columns
        bucket = F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")
        df = df.withColumn("_bucket", bucket)
        touched = [r[0] for r in df.select("_bucket").distinct().collect()]  # at most so many as there are buckets
        if not touched:
            return
        held = []
        if epoch:
            try:
                heads = spark.read.parquet(f"{path}/heads").where(F.col("epoch") < epoch)
                held = [f"{path}/epoch={r.epoch}/_bucket={r.bucket}" for r in heads.where(F.col("bucket").isin(touched)).groupBy("bucket").agg(F.max("epoch").alias("epoch")).collect()]
            except AnalysisException:  # no batch before this one had rows
                held = []
        old = spark.read.parquet(*held).select(names) if held else spark.createDataFrame([], df.select(names).schema)
        now = put(old, df.select(names), id_col, order).withColumn("_bucket", bucket)
        now.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/epoch={epoch}")
        spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{path}/heads/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def percolate(stream: DataFrame, clauses: dict[str, Clause], schema: Schema = Schema()) -> DataFrame:
    """Rows of a stream under the name of every stored filter that they meet."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), (where(stream, c, schema).withColumn("matched", F.lit(n)) for n, c in clauses.items()))


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), by, "n")


def parquet_stream(spark: SparkSession, folder: str, like: DataFrame, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(like.schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder)
