"""From raw documents to token ids: the stages of a training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs``, with the columns of
documents; the last returns token ids.  Columns beyond doc_id, text and source pass through
unread.  Rows are told apart by id and text; rows equal in both are handled alike, save that a
deduplicating stage keeps one of them.  Null texts count as empty; empty tables give empty tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm import bpe, exact, jaccard, mixing, quality
from psephos.llm.tables import by_position, place
from psephos.sources import scratch_folder, stored

WORD = r"[^\x20\x09-\x0D]+"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a ranking learnt from the labels accepts; every fifth id is not learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    learnt = labels.filter(F.crc32(F.col("id").cast("string")) % 5 != 0)
    model = quality.learn(docs.select(F.col("doc_id").alias("id"), "text"), learnt)
    return quality.accepted(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, by an index of digests."""
    return exact.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 per cent similarity of their five-word shingles."""
    return jaccard.keep_first(docs, jaccard.Measure(words=5, percent=80))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources reads it: never, once or twice."""
    names = docs.columns
    docs, (doc_id, text, source) = by_position(docs, "doc_id", "text", "source")
    key = F.struct(F.col(doc_id).alias("id"), place(text).alias("place"))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = stored(docs.select(key.alias("id"), F.array(source).alias("sources"), size.alias("size")))
    taken, _ = mixing.mix(rows, weights=[3, 1, 2], share=1.5, passes=2)
    alike = taken.groupBy("id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    chosen = alike.select("id.*", mixing.copies().alias("__copies")).filter("__copies > 0")
    chosen = stored(chosen.withColumnsRenamed({"id": "__id", "place": "__place"}))
    found = docs.join(chosen, F.col(doc_id).eqNullSafe(F.col("__id")) & (place(text) == F.col("__place")))
    turns = F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__turn")
    return found.select(*docs.columns, turns).drop("__turn").toDF(*names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, as bytes, with their digest and that of the decoded text."""
    return bpe.encoded(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("encode", encode),
]

#: The quality model and the tokenizer cannot be written in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
