"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents. A stage decides row by row from its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, linededup, mixing, quality, shingles
from ledgerloom.llm.common import NULL_ID, marked, table, written


def _kept(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with __kept. The row number keeps the optimiser from moving the test below the columns that it rests on,
    where their arrays would be worked out once for each of their own elements."""
    return rows.withColumn("__row", F.monotonically_increasing_id()).where("__kept and __row >= 0").select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the n-gram verdict both keep."""
    return _kept(quality.quality_rules(docs, quality.trusted_ids(spark, sf_dir)), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share; n_chars follows the text."""
    return linededup.drop_shared_lines(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of a similarity of 0.8 on five-word shingles: that with the smallest id.

    Of rows that repeat an id all stay or go together, but exact repeats stay once.
    """
    found = written(shingles.similar_components(docs.select("doc_id", "text")), "near")
    gone = written(found.where("id <> component").select("id").distinct(), "gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"))
    rows = marked(rows, gone).where("not marked").select("row.*")
    repeated = found.groupBy("id").count().where("count > 1")
    return rows if repeated.isEmpty() else rows.dropDuplicates(["doc_id", "text"])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target weights of sources, languages and topics."""
    return _kept(mixing.mixed(docs), docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids' number and digest, and that of what they decode to, for each document."""
    return bpe.bpe_round_trip(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("byte-level BPE", token_stage),
]

#: The n-gram ratios rest on xxHash64, which SQL has not; tests work the stages out by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
