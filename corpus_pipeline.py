"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, personal data is blotted out,
and what is left is packed into sequences. Every stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, packing, pii, toxicity
from lodestone.llm.common import written


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject, learned from this input's labelled documents.

    Rows stay whole, with all their columns, whatever the names. Null and empty texts, which have no clauses, stay; so do
    repeated rows, each judged alike, and rows without an id. Very long texts are read whole. An empty table gives no rows.
    """
    lexicon, weights = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return toxicity.score(rows, lexicon, weights).where("predicted = 0").select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of linked documents: that of smallest doc_id, rows without an id after all others.

    Documents link at a Jaccard similarity of their five-word sets of 0.8 or more. (op2_ngram_jaccard takes three words and 0.9.)
    Rows are told apart by id and text, so those without an id, and different texts under one id, stay unless their text
    is a duplicate. Of rows that repeat both, the one whose other columns hash lowest stays. Null and empty texts link with
    nothing and stay. Columns stay as they are, whatever their names. An empty table gives no rows.
    """
    chosen = jaccard.rows(docs, n=5, num=80, den=100).where("is_first").select(jaccard.IDENTITY).distinct()
    rows = jaccard.identified(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))).select(*jaccard.IDENTITY, "row")
    one = rows.join(chosen, jaccard.IDENTITY, "left_semi").groupBy(jaccard.IDENTITY)
    return one.agg(F.min_by("row", F.xxhash64(*(F.col("row")[c] for c in docs.columns))).alias("row")).select("row.*")


def blot_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the spans of personal data in their texts replaced by their kind.

    A row-by-row change: null and empty texts, repeated rows and all other columns, whatever their names, stay as they are.
    Very long texts are read whole. An empty table gives no rows.
    """
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, placed in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end token; rows without an id and repeated rows are packed each. Very long texts are cut into
    pieces. Columns besides doc_id and text, whatever their names, play no part. An empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("toxicity", keep_civil), ("near duplicates", keep_one_of_each), ("personal data", blot_personal_data), ("packing", pack)]
#: Packing by a genetic algorithm has no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
