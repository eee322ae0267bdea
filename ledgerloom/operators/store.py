"""A table that grows by whole batches: new rows are added, identical ones refreshed, a conflict rejects its batch.

Every batch writes its rows to a folder of its own and is then published by one small numbered entry of the ledger, which
only one writer can create. What no entry names was never published (a crash, a lost race) and is never read. A batch that
is published already writes nothing: its stored counters come back.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "seq long, batch string, outcome string, folder string, rows long, added long, identical long, conflicts long, seen_at timestamp"
#: Times that a batch is compared anew because another writer was faster.
MOST_TRIES = 20


class Fenced(RuntimeError):
    """Another writer kept publishing first."""


@dataclass(frozen=True)
class Store:
    """Rows of `schema` (DDL) in `folder`, one for each value of `key`, whose column `content` tells versions apart."""

    spark: SparkSession
    folder: str
    schema: str
    key: tuple[str, ...]
    content: str

    def ledger(self) -> DataFrame:
        """An entry for each published batch, rejected ones included."""
        path = f"{self.folder.rstrip('/')}/ledger"
        if not _exists(self.spark, path):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).json(path)

    def _read(self, entries: list, name: str, schema: str) -> DataFrame:
        paths = [f"{e['folder']}/{name}" for e in entries if e["folder"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _loaded(self) -> list:
        # One small row for each batch ever published.
        return self.ledger().where("outcome = 'LOADED'").orderBy("seq").collect()

    def rows(self) -> DataFrame:
        """The published rows with first_seen and last_seen."""
        entries = self._loaded()
        rows = self._read(entries, "rows", f"{self.schema}, first_seen timestamp")
        keys = list(self.key)
        kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in keys)
        seen = self._read(entries, "seen", f"{kinds}, seen_at timestamp").groupBy(*keys).agg(F.max("seen_at").alias("__seen"))
        return rows.join(seen, keys, "left").withColumn("last_seen", F.greatest("first_seen", "__seen")).drop("__seen")

    def classified(self, batch: DataFrame) -> DataFrame:
        """batch with outcome NEW (once for each identity), IDENTICAL or CONFLICT, against the store and within itself.

        Only the stored rows of the batch's identities are looked up: a small batch is broadcast and the store is read
        in place, a large one is joined by shuffling both.
        """
        keys = list(self.key)
        old = self._read(self._loaded(), "rows", f"{self.schema}, first_seen timestamp").select(*keys, F.col(self.content).alias("__old"))
        known = old.join(batch.select(*keys).distinct(), keys)
        own = batch.groupBy(*keys).agg(F.min(F.col(self.content)).alias("__low"), F.max(F.col(self.content)).alias("__high"))
        verdict = own.join(known, keys, "left").select(*keys, F.col("__old").isNotNull().alias("__known"), (F.col("__low").eqNullSafe(F.col("__high")) & (F.col("__old").isNull() | F.col("__old").eqNullSafe(F.col("__low")))).alias("__same"))
        numbered = batch.withColumn("__row", F.monotonically_increasing_id())
        first = numbered.groupBy(*keys).agg(F.min("__row").alias("__first"))
        rows = numbered.join(verdict.join(first, keys), keys)
        outcome = F.when(~F.col("__same"), "CONFLICT").when(F.col("__known") | (F.col("__row") > F.col("__first")), "IDENTICAL").otherwise("NEW")
        return rows.withColumn("outcome", outcome).select(*batch.columns, "outcome")

    def append(self, batch: DataFrame, name: str, seen_at) -> dict:
        """Publishes the batch `name` (of the store's columns) as a whole, or its rejection; returns its ledger entry.

        Rows without an identity raise an error before anything is written. A batch that loses the race for an entry is
        compared with the store again.
        """
        batch = batch.select(*[c.split()[0] for c in self.schema.split(",")])
        if not batch.where(" OR ".join(f"{k} IS NULL" for k in self.key)).isEmpty():
            raise ValueError("rows without an identity")
        for _ in range(MOST_TRIES):
            entries = self.ledger().select("seq", "batch").collect()
            if any(e["batch"] == name for e in entries):
                return self.ledger().where(F.col("batch") == name).first().asDict()
            seq = 1 + max((e["seq"] for e in entries), default=0)
            folder = f"{self.folder.rstrip('/')}/batches/{uuid.uuid4().hex}"
            found = self.classified(batch)
            # Written first, so that rows, counters and verdict come from one comparison.
            found.write.parquet(f"{folder}/compared")
            found = self.spark.read.parquet(f"{folder}/compared")
            n = {r["outcome"]: r["count"] for r in found.groupBy("outcome").count().collect()}
            entry = {"seq": seq, "batch": name, "outcome": "REJECTED" if n.get("CONFLICT") else "LOADED", "folder": folder, "rows": sum(n.values()), "added": n.get("NEW", 0), "identical": n.get("IDENTICAL", 0), "conflicts": n.get("CONFLICT", 0), "seen_at": str(seen_at)}
            if entry["conflicts"]:
                entry |= {"added": 0, "folder": None}
            else:
                found.where("outcome = 'NEW'").drop("outcome").withColumn("first_seen", F.lit(str(seen_at)).cast("timestamp")).write.parquet(f"{folder}/rows")
                found.where("outcome = 'IDENTICAL'").select(*self.key, F.lit(str(seen_at)).cast("timestamp").alias("seen_at")).distinct().write.parquet(f"{folder}/seen")
            if _publish(self.spark, f"{self.folder.rstrip('/')}/ledger", f"{seq:012d}.json", json.dumps(entry)):
                return entry
        raise Fenced(f"{name}: {MOST_TRIES} other batches were published first")


def _system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path)."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, path: str) -> bool:
    system, path = _system(spark, path)
    return bool(system.exists(path))


def _publish(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Creates folder/name with this text, whole and only if it is not there; tells whether it did.

    The text is written to a hidden file first. Moving it fails on a shared store where the name is taken; a local file
    system would overwrite, so there the name is made a link, which fails.
    """
    system, path = _system(spark, folder)
    system.mkdirs(path)
    jvm = spark._jvm
    hidden, target = jvm.org.apache.hadoop.fs.Path(path, f"_{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(path, name)
    out = system.create(hidden, False)
    out.write(bytearray((text + "\n").encode()))
    out.close()
    if system.getScheme() != "file":
        return not system.exists(target) and bool(system.rename(hidden, target))
    local = path.toUri().getPath()
    try:
        os.link(os.path.join(local, hidden.getName()), os.path.join(local, name))
        return True
    except FileExistsError:
        return False
    finally:
        system.delete(hidden, False)
