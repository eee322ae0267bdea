"""Nested JSON payloads to typed rows, and the store of their snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Keys under which an invoice holds its items, first hit wins (fixed values), and spellings of true.
ITEM_KEYS = ["invoice_items", "invoice_item", "items"]
TRUE_WORDS = ["1", "true", "yes", "ano", "closed", "locked"]

RESERVATION = "id BIGINT, code STRING, arrival DATE, reservation_note ARRAY<STRUCT<channel: STRING>>"
ITEM = "array<struct<id: string, signed_amount: string, amount: string, total: string>>"
BILL = "id BIGINT, total STRING, balance STRING, saldo STRING, currency STRING, is_closed STRING, closed STRING"


def flag(x: Column) -> Column:
    """1 or 0 of a boolean in many spellings; null where it is null or empty."""
    return F.when(x.isNotNull() & (x != ""), F.lower(F.trim(x)).isin(TRUE_WORDS).cast("int"))


def parse_reservations(df: DataFrame, payload: str = "payload") -> DataFrame:
    """id, code without a trailing .0, arrival, and the notes that are not empty."""
    p = df.select(F.from_json(payload, RESERVATION).alias("p"))
    notes = F.filter(F.transform(F.coalesce("p.reservation_note", F.array().cast("array<struct<channel:string>>")), lambda n: n["channel"]), lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    return p.select("p.id", S.normalize_internal_code(F.col("p.code")).alias("code"), "p.arrival", notes.alias("channels"))


def explode_items(df: DataFrame, parent: str, payload: str = "payload") -> DataFrame:
    """A row for each embedded item, held as a list or as one object; the amount is the first of three keys."""
    raw = F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in ITEM_KEYS])
    rows = df.select(parent, F.explode(F.from_json(raw, ITEM)).alias("i")).where("i.id IS NOT NULL AND trim(i.id) <> ''")
    return rows.select(parent, F.col("i.id").alias("item_id"), S.to_minor(S.parse_decimal(F.coalesce("i.signed_amount", "i.amount", "i.total", F.lit("0")))).alias("signed_minor"))


def parse_bills(df: DataFrame, payload: str = "payload") -> DataFrame:
    """id, total, balance (else saldo, else 0), currency (CZK where missing), closed flag."""
    p = df.select(F.from_json(payload, BILL).alias("p")).select("p.*")
    minor = lambda *cols: S.to_minor(S.parse_decimal(F.coalesce(*cols, F.lit("0"))))
    return p.select("id", minor("total").alias("total_minor"), minor("balance", "saldo").alias("balance_minor"), S.normalize_currency(F.coalesce("currency", F.lit("CZK"))).alias("currency"), flag(F.coalesce("is_closed", "closed")).alias("closed"))


PART = "id STRING, uuid STRING, currency STRING, amount STRING, total STRING, status STRING"


def parse_parts(df: DataFrame, parent: str, payload: str = "payload") -> DataFrame:
    """Bill items and security deposits: id (else uuid; rows without either are left out), amount (else total, else 0),
    currency (CZK where missing), status (null where empty)."""
    p = df.select(parent, F.from_json(payload, PART).alias("p")).select(parent, "p.*")
    given = lambda c: F.when(F.trim(c) != "", F.trim(c))
    rows = p.withColumn("part_id", F.coalesce(given("id"), given("uuid"))).where("part_id IS NOT NULL")
    return rows.select(parent, "part_id", S.to_minor(S.parse_decimal(F.coalesce("amount", "total", F.lit("0")))).alias("amount_minor"), S.normalize_currency(F.coalesce("currency", F.lit("CZK"))).alias("currency"), given("status").alias("status"))


def merge_snapshots(listed: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """(key, payload map): keys of the detail record override those of the list, nulls too; without detail the list stays."""
    rows = listed.select(key, F.col("payload").alias("__l")).join(detail.select(key, F.col("payload").alias("__d")), key, "left")
    both = F.map_zip_with("__l", "__d", lambda k, a, b: F.when(F.array_contains(F.map_keys("__d"), k), b).otherwise(a))
    return rows.select(key, F.when(F.col("__d").isNull(), F.col("__l")).otherwise(both).alias("payload"))


def new_snapshots(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Payloads that the store has not, once for each type, id and content."""
    keys = ["resource_type", "external_id", "content_hash"]
    return batch.dropDuplicates(keys).join(store, keys, "left_anti")
