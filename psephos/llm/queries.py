"""One query per operator of this package, over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm import audit, bpe, chunk_bpe, ctw, exact, fm_dedup, jaccard, licenses, mixing, quality, rules, secrets, treap
from psephos.sources import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet").withColumnRenamed("doc_id", "id")


@query
def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of one and a half times the corpus takes from each document."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    rows = stored(
        documents(spark, folder).select(
            F.col("doc_id").alias("id"), F.array("source").alias("sources"), size.cast("long").alias("size")
        )
    )
    taken, sources = mixing.mix(rows, weights=[3, 1, 2], share=1.5, passes=2)
    joined = taken.join(F.broadcast(sources), F.col("sources")[0].eqNullSafe(F.col("source")))
    return joined.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule counts, the two fixed rules, and the verdict of an isolation forest."""
    labels = labelled(spark, folder)
    judged = rules.judge(documents(spark, folder), labels.select("id", F.col("quality").alias("label")))
    return judged.select(F.col("id").alias("doc_id"), *rules.COUNTS, "base_failed", "kept", "anomaly")


@query
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed phrases and license rules found in each document."""
    found = licenses.scan(documents(spark, folder))
    return found.withColumnRenamed("id", "doc_id")


@query
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    rows = bpe.encoded(documents(spark, folder))
    return rows.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op7_quality_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of each document by a ranking learnt from the labels outside every fifth of the ids."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = documents(spark, folder).select(F.col("doc_id").alias("id"), "text")
    labels = labelled(spark, folder).select("id", F.col("quality").alias("label"))
    learnt = labels.filter(F.crc32(F.col("id").cast("string")) % 5 != 0)
    model = quality.learn(docs, learnt)
    scores = quality.quality_scores(docs, model).withColumnRenamed("id", "doc_id")
    return scores.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= quality.CUT, 1).otherwise(0).alias("predicted")
    )


@query
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in each document: the fixed patterns and what lexing assignments adds."""
    found = secrets.scan(documents(spark, folder)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query
def op9_exact_index(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the one that stays of those with equal text."""
    rows = stored(exact.digests(documents(spark, folder)))
    result = exact.deduplicate(rows, exact.new_index(spark, rows.count()))
    return result.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


@query
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents linked by 90 per cent similarity of their three-word shingles."""
    found = jaccard.similar(documents(spark, folder), jaccard.Measure(words=3, percent=90))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


@query
def op3_ctw_score(spark: SparkSession, folder: str) -> DataFrame:
    """Code lengths under context-tree weighting and under word counts, learnt outside every seventh of the ids."""
    docs = documents(spark, folder).withColumn("__held", F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    scores = ctw.score(docs, held_out="__held").withColumnRenamed("id", "doc_id")
    return scores.drop("bits_per_byte")


@query
def op6_fm_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Words left of each document when passages of earlier documents are removed."""
    return fm_dedup.removed(documents(spark, folder)).withColumnRenamed("id", "doc_id")


@query
def op11_chunk_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, shared chunks being encoded once."""
    rows = chunk_bpe.encoded(documents(spark, folder))
    return rows.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from each language in every order, with the labels that are lost."""
    flags = [F.col("quality").alias("good_lost"), F.col("toxic").alias("toxic_lost")]
    labels = labelled(spark, folder).select("id", *flags)
    return audit.audit(documents(spark, folder), labels, ["good_lost", "toxic_lost"])


@query
def op13_treap_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = treap.search(treap.build_index(documents(spark, folder)), items, k=50)
    return found.select("item_id", "rank", "doc_id", "score")
