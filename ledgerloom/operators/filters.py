"""Filters of documents and sources by criteria, given as a dict or as stored JSON."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that a search looks into (fixed values), by kind of row.
TEXT_COLUMNS = {
    "DOCUMENT": ("code", "invoice_id", "internal_code", "booking_reference"),
    "BOOKING": ("booking_reference", "payment_id"),
    "CARD": ("seq", "arn", "auth_code", "masked_card", "terminal"),
    "CASHBOOK": ("receipt", "variable_symbol", "client", "number"),
    "AUDIT": ("event_code", "object_ref", "message", "correlation_id"),
}


def criteria_of(stored) -> dict:
    """A dict as it is; of a text, the JSON object that it holds, and no criteria where it holds none."""
    if isinstance(stored, dict):
        return stored
    try:
        found = json.loads(stored)
    except (TypeError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def predicates(df: DataFrame, stored, kind: str, today: Column | None = None) -> list[Column]:
    """The tests that criteria ask for, of: status (one or several), currency, days (age at most), from and to (dates),
    amount_from and amount_to, type (CREDIT: negative; INVOICE: not), reference (true: has one), event_code, text (in any
    text column of the kind that df has, whatever the case). Criteria that are null or empty, and others, ask for nothing.
    """
    c = {k: v for k, v in criteria_of(stored).items() if v not in (None, "", [])}
    day = next((x for x in ("doc_date", "paid_on", "day") if x in df.columns), None)
    minor = next((x for x in ("total_minor", "amount_minor") if x in df.columns), None)
    out = []
    if "status" in c:
        out.append(F.col("status").isin(c["status"] if isinstance(c["status"], list) else [c["status"]]))
    out += [F.col(k) == c[k] for k in ("currency", "event_code") if k in c]
    if "days" in c:
        out.append(F.datediff(today if today is not None else F.current_date(), day) <= int(c["days"]))
    out += [F.col(day) >= F.lit(c["from"]).cast("date")] if "from" in c else []
    out += [F.col(day) <= F.lit(c["to"]).cast("date")] if "to" in c else []
    out += [F.col(minor) >= int(c["amount_from"])] if "amount_from" in c else []
    out += [F.col(minor) <= int(c["amount_to"])] if "amount_to" in c else []
    if c.get("type") in ("CREDIT", "INVOICE"):
        out.append(F.col(minor) < 0 if c["type"] == "CREDIT" else F.col(minor) >= 0)
    if "reference" in c:
        out.append(F.col("booking_reference").isNotNull() if c["reference"] else F.col("booking_reference").isNull())
    if "text" in c:
        there = [F.lower(F.coalesce(F.col(x).cast("string"), F.lit(""))).contains(str(c["text"]).strip().lower()) for x in TEXT_COLUMNS[kind] if x in df.columns]
        out.append(reduce(lambda a, b: a | b, there, F.lit(False)))
    return out


def filter_rows(df: DataFrame, stored, kind: str, today: Column | None = None) -> DataFrame:
    """Rows of df that meet the criteria (see predicates), ordered by the columns of `sort`, a leading - for descending."""
    rows = reduce(lambda d, p: d.where(p), predicates(df, stored, kind, today), df)
    keys = [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in criteria_of(stored).get("sort", []) if k.lstrip("-") in df.columns]
    return rows.orderBy(*keys) if keys else rows


def filter_sources(kinds: dict[str, DataFrame], stored, today: Column | None = None) -> DataFrame:
    """(source_id, kind, amount_minor, currency) of the sources of each kind that meet the criteria."""
    parts = [filter_rows(df, {k: v for k, v in criteria_of(stored).items() if k != "sort"}, kind, today).select("source_id", F.lit(kind).alias("kind"), "amount_minor", "currency") for kind, df in kinds.items()]
    return reduce(DataFrame.unionByName, parts)
