"""Continuous ingestion and pairing with Structured Streaming."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Store

LATENESS = "48 hours"
DAY = 24 * 60 * 60 * 1000


def deduplicated(stream: DataFrame, time_col: str, identity: list[str]) -> DataFrame:
    """Each identity and content once; rows may come again for 48 hours."""
    return stream.withWatermark(time_col, LATENESS).dropDuplicatesWithinWatermark(identity)


def read_drops(spark: SparkSession, folder: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(folder)


def ingest_drops(spark: SparkSession, folder: str, schema, store: Store, checkpoint: str, prepare=None, fmt: str = "parquet", seen_at=None) -> None:
    """Takes every file that has come to folder into the store and stops; files of earlier runs are not taken again.

    A file is a batch: it is loaded or rejected as a whole, after those that came before it. Its name in the ledger is
    its path, so a file that is handed over twice (a crash after publishing and before the stream's own commit) is
    published once. `prepare` makes a file's rows those of the store; one that raises an error ends the run, and the
    next run goes on with the same file. `seen_at` (default: now) is the time of each batch.
    """
    stream = read_drops(spark, folder, schema, fmt, maxFilesPerTrigger=1, latestFirst=False).select("*", F.col("_metadata.file_path").alias("__file"))

    def take(rows: DataFrame, batch_id: int) -> None:
        name = rows.select("__file").first()  # one file each
        if name is None:
            return
        rows = rows.drop("__file")
        store.append(prepare(rows) if prepare else rows, name[0], seen_at or pd.Timestamp.now("UTC").tz_localize(None))

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def paired(cash: DataFrame, source: DataFrame, days: int = 2) -> DataFrame:
    """Stream-stream join on currency and amount within `days`; both sides' state is bounded by watermarks."""
    a = cash.withWatermark("cash_ts", LATENESS)
    b = source.withWatermark("source_ts", LATENESS)
    near = F.expr(f"source_ts BETWEEN cash_ts - INTERVAL {days} DAYS AND cash_ts + INTERVAL {days} DAYS")
    return a.join(b, (F.col("cash_currency") == F.col("source_currency")) & (F.col("cash_minor") == F.col("source_minor")) & near)


class Waiting:
    """One key's free sources, by day, and undecided cash rows: (time in ms, id) each."""

    def __init__(self, text: str | None):
        self.free: dict[int, list[tuple]] = {}
        free, cash = json.loads(text) if text else ([], [])
        self.cash = [tuple(x) for x in cash]
        for at, row in free:
            self.add(at, row)

    def add(self, at: int, row) -> None:
        self.free.setdefault(at // DAY, []).append((at, row))

    def text(self) -> str:
        return json.dumps([[s for day in self.free.values() for s in day], self.cash])

    def decide(self, watermark: int, days: int) -> list[tuple]:
        """Cash rows in order whose sources have all come by: exactly one free source within `days` is consumed. A row costs
        as much as the window has days."""
        out, n = [], 0
        self.cash.sort()
        while n < len(self.cash) and self.due(self.cash[n], days) <= watermark:
            at, row = self.cash[n]
            n += 1
            near = [d for d in range(at // DAY - days, at // DAY + days + 1) if self.free.get(d)]
            one = len(near) == 1 and len(self.free[near[0]]) == 1
            out.append((row, "MATCHED" if one else "SEVERAL" if near else "NONE", self.free[near[0]].pop()[1] if one else None))
        self.cash = self.cash[n:]
        self.free = {d: rows for d, rows in self.free.items() if rows and self.gone(rows[0], days) > watermark}
        return out

    @staticmethod
    def due(row: tuple, days: int) -> int:
        """When every source that may pair with a cash row has come: the end of its last day."""
        return (row[0] // DAY + days + 1) * DAY

    @staticmethod
    def gone(row: tuple, days: int) -> int:
        """When every cash row that may take a source has been decided."""
        return (row[0] // DAY + 2 * days + 1) * DAY

    def next(self, days: int) -> int | None:
        times = [self.due(r, days) for r in self.cash[:1]] + [self.gone(rows[0], days) for rows in self.free.values()]
        return min(times) if times else None


def paired_once(rows: DataFrame, days: int = 2, lateness: str = LATENESS) -> DataFrame:
    """The cash-book replay as a stream: rows (movement_id, currency, amount_minor, ts, cash: 1 or 0) in any order within
    `lateness`; returns movement_id, outcome (MATCHED, NONE, SEVERAL) and source_id of each cash row, once.

    State is kept for each (currency, amount): sources that are still free, and cash rows until the watermark has passed
    the last day on which a source may come. Cash rows of a key are decided by time, then id, and consume their source, so
    a source pairs once. Sources leave the state when no later cash row can reach them. Rows that come after the watermark
    are dropped. Rows without an amount, currency or time are left out.
    """

    def replay(key, frames, state):
        held = Waiting(state.get[0] if state.exists else None)
        for pdf in frames:
            at = pd.to_datetime(pdf["ts"]).astype("datetime64[ms]").astype("int64").tolist()
            for is_cash, t, row in zip(pdf["cash"].tolist(), at, pdf["movement_id"].tolist()):
                held.cash.append((t, row)) if is_cash else held.add(t, row)
        watermark = state.getCurrentWatermarkMs()
        out = held.decide(watermark, days)
        wake = held.next(days)
        if wake is None:
            if state.exists:
                state.remove()
        else:
            state.update((held.text(),))
            state.setTimeoutTimestamp(max(wake, watermark + 1))
        yield pd.DataFrame(out, columns=["movement_id", "outcome", "source_id"]).astype({"movement_id": "int64", "source_id": "Int64"})

    rows = rows.where("currency IS NOT NULL AND amount_minor IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", lateness)
    return rows.groupBy("currency", "amount_minor").applyInPandasWithState(replay, "movement_id long, outcome string, source_id long", "held string", "append", "EventTimeTimeout")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends all that is there to a Parquet table and stops."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
