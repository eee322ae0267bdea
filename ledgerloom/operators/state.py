"""Ingestion state: duplicates and conflicts, merges of snapshots, revision alerts."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_identity(rows: DataFrame, keys: list[str], content: str) -> DataFrame:
    """One row for each identity: rows seen, distinct contents, outcome UNIQUE, DUPLICATE or CONFLICT."""
    per = rows.groupBy(*keys).agg(F.count("*").alias("seen"), F.count_distinct(content).alias("contents"))
    return per.withColumn("outcome", F.when(F.col("contents") > 1, "CONFLICT").when(F.col("seen") > 1, "DUPLICATE").otherwise("UNIQUE"))


def classify_new(batch: DataFrame, store: DataFrame, key: str, content: str) -> DataFrame:
    """batch with outcome NEW, IDENTICAL or CONFLICT against the store."""
    old = store.select(key, F.col(content).alias("__old"))
    outcome = F.when(F.col("__old").isNull(), "NEW").when(F.col("__old") == F.col(content), "IDENTICAL").otherwise("CONFLICT")
    return batch.join(old, key, "left").withColumn("outcome", outcome).drop("__old")


def keep_bucketed(rows: DataFrame, keys: list[str], table: str, buckets: int) -> DataFrame:
    """rows as a table of the catalogue, bucketed and sorted by their identity: a batch is compared with it by shuffling
    the batch alone. Growing it by classify_new's new rows keeps the buckets (see grow_bucketed)."""
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)


def grow_bucketed(new: DataFrame, keys: list[str], table: str, buckets: int) -> None:
    new.write.mode("append").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)


def duplicate_files(files: DataFrame, runs: DataFrame, counters: list[str]) -> DataFrame:
    """New runs for files (file_id, content_hash): a content that a stored run (content_hash, run_no, counters) has loaded
    makes a DUPLICATE run with the counters of the latest such run; others are NEW without counters."""
    last = runs.groupBy("content_hash").agg(F.max_by(F.struct(*counters), "run_no").alias("__last"))
    rows = files.join(last, "content_hash", "left")
    return rows.select("file_id", "content_hash", F.when(F.col("__last").isNull(), "NEW").otherwise("DUPLICATE").alias("status"), *[F.col(f"__last.{c}").alias(c) for c in counters])


def upsert(new: DataFrame, old: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """Full outer merge: the new snapshot with outcome INSERTED, UPDATED, UNCHANGED or KEPT and row_version."""
    n, o = new.alias("n"), old.alias("o")
    both = n.join(o, F.col(f"n.{key}") == F.col(f"o.{key}"), "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in watched])
    outcome = F.when(F.col(f"o.{key}").isNull(), "INSERTED").when(F.col(f"n.{key}").isNull(), "KEPT").when(same, "UNCHANGED").otherwise("UPDATED")
    version = F.when(F.col(f"o.{key}").isNull(), 1).otherwise(F.col("o.row_version") + F.when(F.col(f"n.{key}").isNotNull() & ~same, 1).otherwise(0))
    cols = [F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in watched]
    return both.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *cols, version.cast("bigint").alias("row_version"), outcome.alias("outcome"))


#: Hours that a run reads again before its checkpoint: least and most.
OVERLAP_HOURS = (0, 168)


def incremental_window(rows: DataFrame, time_col: str, checkpoint: datetime | None, hours: int = 48) -> DataFrame:
    """The rows of an incremental run: from `hours` (0 to 168) before the checkpoint on; all without a checkpoint. Rows
    without a time always come. What is read again is told by its content (classify_new)."""
    if not OVERLAP_HOURS[0] <= hours <= OVERLAP_HOURS[1]:
        raise ValueError("an overlap of 0 to 168 hours")
    if checkpoint is None:
        return rows
    return rows.where(F.col(time_col).isNull() | (F.col(time_col) >= F.lit(checkpoint) - F.expr(f"INTERVAL {hours} HOURS")))


def store_checkpoint(loaded: DataFrame, time_col: str, source: str, folder: str) -> None:
    """Stores the latest time of what a run has loaded; a run without times leaves the checkpoint as it is."""
    latest = loaded.agg(F.max(time_col).alias("at")).where("at IS NOT NULL").select(F.lit(source).alias("source"), F.col("at").cast("timestamp").alias("at"))
    latest.write.mode("append").parquet(folder)


def stored_checkpoint(spark, source: str, folder: str) -> datetime | None:
    """The latest stored time of a source."""
    return spark.read.schema("source string, at timestamp").parquet(folder).where(F.col("source") == source).agg(F.max("at").alias("at")).first()["at"]
