"""Readers of the three file sources and the CSV sink. All values are read as text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import csv_safe
from ..operators.scratch import kept

#: Required headers (fixed values of the file formats).
BANK_HEADERS = ["Typ transakce", "ID Terminálu", "ID POS", "Datum a čas vzniku", "Čas připsání na server", "Datum zaúčtování", "Částka", "Cashback", "Spropitné", "DCC", "Měna", "ARN kód", "Číslo karty/Číslo účtu", "Autoriz. kód", "Var. symbol", "Var. symbol 2", "SEQ ID", "Vydavatel karty", "Způsob načtení karty", "Obchodní místo", "Adresa obchodního místa"]
BOOKING_HEADERS = ["Typ faktury", "Číslo rezervace", "Datum příjezdu", "Checkout", "Jméno hosta", "Poskytovatel platebních služeb", "Status rezervace", "Status platby", "Měna", "Částka", "Datum vyplacení částky", "ID platby"]
CASHBOOK_HEADERS = ["Vystaveno", "Pohyb", "Číslo", "Označení", "Klient", "Příjem", "Výdaj", "Stav pokladny", "Měna", "Forma úhrady", "Pokladna", "Variabilní symbol", "Vystavil"]
HEADER_ROWS = 50


def header_key(x: str | None) -> str:
    """Accent-insensitive, case-folded, blanks collapsed."""
    text = unicodedata.normalize("NFKD", (x or "").replace("﻿", "")).casefold()
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).split())


def read_table(spark: SparkSession, path: str, required: list[str], header_rows: int = 1) -> DataFrame:
    """Rows under the header, columns renamed to `required` in any order, and row_number from 1.

    The header is the first of the top `header_rows` rows that has every required name; without one the file is refused.
    """
    # As many columns as the first lines have commas; a title line above the header has fewer.
    top = spark.read.text(path).limit(4 * HEADER_ROWS).agg(F.max(F.regexp_count("value", F.lit(",")))).first()[0]
    schema = ", ".join(f"_c{i} string" for i in range((top or 0) + 1))
    raw = spark.read.csv(path, schema=schema, header=False, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    # Written once with its place: the split's number above 33 bits, the row's place in the split below.
    raw = kept(raw.withColumn("__at", F.monotonically_increasing_id()), "table")
    want = {header_key(h): h for h in required}
    for row in raw.orderBy("__at").limit(header_rows).collect():
        names: dict[str, str] = {}
        for c in raw.columns[:-1]:
            names.setdefault(header_key(row[c]), c)
        if want.keys() <= names.keys():
            rows = numbered(raw, "__at", row["__at"])
            rows = rows.select("row_number", *[F.trim(names[k]).alias(h) for k, h in want.items()])
            return rows.where(F.coalesce(*[F.when(F.col(f"`{h}`") != "", F.lit(1)) for h in required]).isNotNull())
    raise ValueError("no header row with all required names")


def numbered(raw: DataFrame, at: str, after: int) -> DataFrame:
    """The rows whose place is behind `after` with row_number from 1, in two passes: the rows of each split, then each
    split's offset. Only one count for each split comes to the driver."""
    split = F.shiftright(at, 33)
    rows = raw.where(F.col(at) > after)
    counts = sorted((r["split"], r["first"], r["n"]) for r in rows.groupBy(split.alias("split")).agg(F.min(at).alias("first"), F.count("*").alias("n")).collect())
    offsets, before = [], 0
    for number, first, n in counts:
        offsets.append((number, before - first + 1))  # places of a split follow each other
        before += n
    shift = raw.sparkSession.createDataFrame(offsets, "split long, shift long")
    return rows.withColumn("split", split).join(F.broadcast(shift), "split").withColumn("row_number", F.col(at) + F.col("shift")).drop("split", "shift")


def read_bank_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, BANK_HEADERS, HEADER_ROWS)


def read_booking_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, BOOKING_HEADERS)


def read_cashbook_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, CASHBOOK_HEADERS, HEADER_ROWS)


def export_csv(df: DataFrame, path: str, selection: DataFrame | None = None, key: str | None = None) -> None:
    """df with a header; text that a spreadsheet would run gets a leading apostrophe. With a selection only the rows whose
    `key` is among its first column's values, each row once whatever the selection repeats."""
    if selection is not None:
        df = df.join(selection.select(selection[selection.columns[0]].alias(key)), key, "left_semi").select(df.columns)
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    df.select(*[csv_safe(F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`") for c in df.columns]).write.mode("overwrite").csv(path, header=True, escape='"')
