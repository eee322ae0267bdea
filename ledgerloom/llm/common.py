"""What several operators share: the shared folder, written intermediate tables, id handling."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a Java pattern and as bytes.
WHITE = r"[\x20\x09-\x0D]"
#: A null id takes part as the smallest id there is.
NULL_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one in local mode (tests)
    and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Only the id (null: NULL_ID) and the named columns, so that other columns cannot clash."""
    return docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("id"), *[docs[c].alias(new) for c, new in zip(cols[::2], cols[1::2])])


def shown_id(col: str = "id") -> Column:
    """The id as it was given: NULL_ID is null again."""
    return F.when(F.col(col) != NULL_ID, F.col(col))


#: Bits of the map that says which ids may be among some others; 4 MB are broadcast whatever the input.
MAP_BITS = 1 << 25


def marked(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """rows with a boolean `marked`: whether their key is among ids (one column, distinct and written before).

    A bit map of fixed size, one bit for the hash of each id, is broadcast; rows whose bit is not set are settled in the
    scan and only the others are shuffled, to be joined exactly. A full map only costs its gain. The same plan at every size.
    """
    name = ids.columns[0]
    bit = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(MAP_BITS))
    maps = ids.select(bit(name).alias("bit")).groupBy(F.call_function("bitmap_bucket_number", F.col("bit")).alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("map"))
    maps = written(maps, "maps")  # MAP_BITS / 32,768 rows at most
    at = F.call_function("bitmap_bit_position", bit(key))
    byte = F.conv(F.hex(F.substring("map", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    tested = rows.withColumn("__bucket", F.call_function("bitmap_bucket_number", bit(key))).join(F.broadcast(maps.withColumnRenamed("bucket", "__bucket")), "__bucket", "left")
    tested = tested.withColumn("__maybe", F.coalesce(F.expr("1") == F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)), F.lit(False))).drop("__bucket", "map")
    no = tested.where("not __maybe").drop("__maybe").withColumn("marked", F.lit(False))
    sure = ids.select(F.col(name).alias(key), F.lit(True).alias("marked")).hint("merge")
    some = tested.where("__maybe").drop("__maybe").join(sure, key, "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    return no.unionByName(some)


def arrow_bytes(column) -> list:
    """UTF-8 bytes of a string column of a record batch; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batch, limit: int = 8 << 20):
    """Slices of a record batch with about `limit` bytes at most (one row at least)."""
    if batch.num_rows == 0:
        return
    n = max(1, min(batch.num_rows, int(batch.num_rows * limit / max(batch.nbytes, 1))))
    for i in range(0, batch.num_rows, n):
        yield batch.slice(i, n)
