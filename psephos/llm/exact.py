"""Exact deduplication against a persistent index of digests.

A text counts by the SHA-256 digest of what remains of it without white space.  The index is a
table bucketed and sorted by digest, one row per digest seen.  New rows are reduced to
one row per digest, joined with the index by sort-merge, and what the index lacks is appended.

Rows come in named batches.  What a batch itself added counts as unseen when the batch comes again, so a
job that failed after the addition is run again with the same name and the same rows, gives the same
result and adds nothing twice.

Defined cases: a null text is an empty one; among equal texts the row with most code points
stays, then the smallest id, and a null id comes last; of rows equal in id and length too,
exactly one stays.  Columns besides id and text are not read, so their names cannot clash.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.tables import by_position, join_groups
from psephos.sources import scratch_folder, stored

SPACES = r"[\x20\x09-\x0D]+"
#: Digests per bucket that a task sorts, some 200 MB; an index starts with ``LEAST_BUCKETS`` of them.
BUCKET_ROWS = 1 << 21
LEAST_BUCKETS = 32


def digest(text: str) -> Column:
    """SHA-256, in lower-case hex, of a text without its white space."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, ""), 256)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, length) of every row."""
    return docs.select(
        F.col(doc_id).cast("long").alias("id"),
        digest(text).alias("digest"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("length"),
    )


def best_row() -> Column:
    """The row of a group that stays, as a struct whose smallest value wins."""
    return F.min(F.struct((-F.col("length")).alias("less"), F.col("id").isNull().alias("unknown"), F.col("id")))


@dataclass
class DigestIndex:
    """The table of digests seen so far, bucketed and sorted by digest.

    ``buckets`` should give buckets that a task can sort, as ``new_index`` chooses them; an index that exists keeps its
    own.  Each addition appends one sorted file per bucket, which ``compacted`` merges; ``path`` must be a
    folder that all executors share.
    """

    spark: SparkSession
    name: str
    path: str
    buckets: int = LEAST_BUCKETS

    def __post_init__(self) -> None:
        if self.spark.catalog.tableExists(self.name):
            told = self.spark.sql(f"DESCRIBE FORMATTED {self.name}").filter("col_name = 'Num Buckets'").first()
            self.buckets = int(told["data_type"])
        else:
            self.spark.sql(
                f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, length BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add rows of digests that the index lacks, one sorted file per bucket."""
        rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").format(
            "parquet"
        ).mode("append").saveAsTable(self.name)

    def add(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """Index the digests of ``rows`` (as ``digests`` gives them); the rows' groups come back.

        One row per digest: ``keep_id`` and ``kept_length`` of the row that stays, ``group_size``
        rows here, and ``known``, whether the index had the digest before, in which case its
        row stays.  A ``batch`` that comes again under its name finds what it found the first time; without
        a name it is a new one.
        """
        batch = batch or uuid.uuid4().hex
        groups = rows.groupBy("digest").agg(best_row().alias("best"), F.count(F.lit(1)).alias("group_size"))
        earlier = self.table().filter(F.col("batch") != batch)
        seen = earlier.select("digest", F.col("keep_id").alias("old_id"), F.col("length").alias("old_length"))
        merged = stored(
            groups.join(seen.hint("merge"), "digest", "left").select(
                "digest",
                "group_size",
                F.col("old_length").isNotNull().alias("known"),
                F.when(F.col("old_length").isNotNull(), F.col("old_id")).otherwise(F.col("best.id")).alias("keep_id"),
                F.coalesce("old_length", -F.col("best.less")).alias("kept_length"),
            )
        )
        new = merged.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        self.append(new.select("digest", "keep_id", F.col("kept_length").alias("length"), F.lit(batch).alias("batch")))
        return merged

    def compacted(self) -> DigestIndex:
        """The same digests in a new index of one sorted file per bucket, with buckets for its present size.

        This one stays as it is, so readers and a failed run lose nothing; drop it once the new one is in use.
        """
        other = new_index(self.spark, self.table().count())
        other.append(self.table())
        return other


def new_index(spark: SparkSession, rows: int = 0) -> DigestIndex:
    """An empty index in the shared folder, with buckets for about ``rows`` digests."""
    path = scratch_folder(spark, "digest_index")
    buckets = max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
    return DigestIndex(spark, path.rsplit("/", 1)[1].replace("-", "_"), path, buckets)


def deduplicate(rows: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Every row of ``rows`` (stored digests) with the row that stays for it; ``batch`` names them, as in ``add``.

    Columns id, digest, length, keep_id, group_size, times (rows equal in the first three), kept.  Equal rows are counted before the join and
    told apart after it.
    """
    groups = index.add(rows, batch)
    same = rows.groupBy("digest", "length", "id").agg(F.count(F.lit(1)).alias("times"))
    joined = join_groups(stored(same), groups, "digest", "group_size")
    stays = ~F.col("known") & F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("kept_length"))
    return joined.select(
        "id", "digest", "length", "keep_id", "group_size", "times", stays.alias("stays"),
        F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("turn"),
    ).withColumn("kept", F.col("stays") & (F.col("turn") == 1)).drop("stays", "turn")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, against an empty index."""
    names = docs.columns
    docs, (doc_id, text) = by_position(docs, doc_id, text)
    rows = stored(digests(docs, doc_id, text))
    kept = deduplicate(rows, new_index(docs.sparkSession, rows.count())).filter("kept")
    kept = kept.select(*(F.col(name).alias(f"__{name}") for name in ("id", "digest", "length", "times")))
    found = docs.join(
        stored(kept),
        (digest(text) == F.col("__digest"))
        & F.col(doc_id).cast("long").eqNullSafe(F.col("__id"))
        & (F.length(F.coalesce(F.col(text), F.lit(""))) == F.col("__length")),
    )
    once = found.filter("__times = 1")
    # Rows equal in id, length and text without white space: any one of them.
    again = found.filter("__times > 1").dropDuplicates(["__digest"])
    return once.unionByName(again).select(*docs.columns).toDF(*names)
