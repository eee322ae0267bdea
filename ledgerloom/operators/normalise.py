"""Raw rows of the imports to typed ones: kinds, mapped values, errors, preflight counts. All built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Row types of a bank export and words of a cash book (fixed values, lower case).
SALES = ["prodej"]
CLOSURES = ["uzávěrka", "uzaverka"]
REFUNDS = ["refundace", "storno", "vrácení", "vraceni", "refund"]
SUMMARIES = ["počet transakcí:", "pocet transakci:", "suma částek:", "suma castek:"]
CARD_FORMS = ["card", "karta", "platebni karta", "platební karta", "payment card"]
SYSTEM_ROWS = ["počáteční stav", "pocatecni stav", "uzávěrka", "uzaverka", "konečný stav", "konecny stav"]


def folded(x: Column) -> Column:
    """Lower case, blanks collapsed; null is empty."""
    return F.lower(S.normalize_text(F.coalesce(x, F.lit(""))))


def blank(*cols: str) -> Column:
    return F.trim(F.concat_ws("", *cols)) == ""


def apply_value_mapping(df: DataFrame, mapping: DataFrame, column: str, out: str) -> DataFrame:
    """df with `out`: the meaning of the folded value in mapping (raw, meaning), else null. One entry for a value."""
    known = mapping.select(F.col("raw").alias("__raw"), F.col("meaning").alias(out)).dropDuplicates(["__raw"])
    return df.join(known, folded(F.col(column)) == F.col("__raw"), "left").drop("__raw")


def classify_bank(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Bank rows with kind: BLANK, SUMMARY, CLOSURE, SALE, REFUND or UNKNOWN. A mapping comes before the type's own words."""
    text, m = folded(F.col("kind_text")), F.col("meaning")
    summary = F.lit(False)
    for prefix in SUMMARIES:
        summary = summary | text.startswith(prefix)
    kind = (
        F.when(blank("kind_text", "terminal", "seq", "amount_text", "currency_text"), "BLANK").when(m == "IGNORE", "SUMMARY").when(m.isNotNull(), m)
        .when(summary, "SUMMARY").when(text.isin(CLOSURES), "CLOSURE").when(text.isin(REFUNDS), "REFUND").when(text.isin(SALES), "SALE").otherwise("UNKNOWN")
    )
    return apply_value_mapping(df, mapping, "kind_text", "meaning").withColumn("kind", kind).drop("meaning")


def normalize_bank(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Classified rows with amount_minor (refunds negative), tip_minor (0 where empty), currency and error; zero amounts are no transactions."""
    rows = classify_bank(df, mapping)
    pays = F.col("kind").isin("SALE", "REFUND")
    minor = S.to_minor(S.parse_decimal(F.col("amount_text")))
    rows = rows.withColumn("amount_minor", F.when(pays, F.when(F.col("kind") == "REFUND", -F.abs(minor)).otherwise(minor)))
    rows = rows.withColumn("currency", F.when(pays, S.normalize_currency(F.col("currency_text"))))
    rows = rows.withColumn("tip_minor", F.when(pays, F.when(folded(F.col("tip_text")) == "", F.lit(0).cast("bigint")).otherwise(S.to_minor(S.parse_decimal(F.col("tip_text"))))))
    bad = F.when(F.col("kind") == "UNKNOWN", "UNKNOWN_TYPE").when(pays & ((folded(F.col("terminal")) == "") | (folded(F.col("seq")) == "")), "NO_IDENTITY")
    bad = bad.when(pays & (F.col("amount_minor").isNull() | F.col("tip_minor").isNull()), "BAD_AMOUNT").when(pays & F.col("currency").isNull(), "BAD_CURRENCY")
    rows = rows.withColumn("error", bad)
    return rows.withColumn("kind", F.when(F.col("error").isNull() & (F.col("amount_minor") == 0), "SUMMARY").otherwise(F.col("kind")))


def normalize_cashbook(df: DataFrame, zone: str = "Europe/Prague") -> DataFrame:
    """Cash-book rows with reason (BLANK, SYSTEM_OR_NO_ID, NON_CARD, ZERO; null where kept), error, amount_minor, direction and time in UTC."""
    side = lambda c: F.coalesce(S.to_minor(S.parse_decimal(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("0")))), F.lit(0).cast("bigint"))
    rows = df.withColumn("__in", side(F.col("income"))).withColumn("__out", side(F.col("expense")))
    early = F.when(blank("number", "label", "form", "income", "expense"), "BLANK").when(folded(F.col("label")).isin(SYSTEM_ROWS) | (folded(F.col("number")) == ""), "SYSTEM_OR_NO_ID").when(~folded(F.col("form")).isin(CARD_FORMS), "NON_CARD")
    rows = rows.withColumn("reason", early.when((F.col("__in") == 0) & (F.col("__out") == 0), "ZERO"))
    rows = rows.withColumn("error", F.when(F.col("reason").isNull() & (F.col("__in") != 0) & (F.col("__out") != 0), "BOTH_SIDES"))
    good = F.col("reason").isNull() & F.col("error").isNull()
    rows = rows.withColumn("amount_minor", F.when(good, F.when(F.col("__in") != 0, F.col("__in")).otherwise(-F.col("__out"))))
    rows = rows.withColumn("direction", F.when(F.col("amount_minor") > 0, "INCOME").when(F.col("amount_minor") < 0, "EXPENSE"))
    return rows.withColumn("occurred_at", F.when(good, F.to_utc_timestamp(S.parse_datetime(F.col("issued")), zone))).withColumn("identity", S.normalize_internal_code(F.trim("number"))).drop("__in", "__out")


def validate_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with one). A batch is taken only when the second is empty."""
    return df.where("error IS NULL"), df.where("error IS NOT NULL")


def preflight(df: DataFrame, file: str, runs: DataFrame) -> DataFrame:
    """For each file: rows, usable and rejected ones, currencies, and whether the file is in runs (one row for each file there)."""
    per = df.groupBy(file).agg(F.count("*").alias("n_rows"), F.count_if(F.col("error").isNull() & F.col("kind").isin("SALE", "REFUND")).alias("usable"), F.count_if(F.col("error").isNotNull()).alias("rejected"), F.array_join(F.sort_array(F.collect_set("currency")), ",").alias("currencies"))
    return per.join(runs.select(file).distinct().withColumn("__old", F.lit(1)), file, "left").withColumn("duplicate", F.coalesce("__old", F.lit(0))).drop("__old")


#: Meanings of a payout line's states that make it eligible (fixed values).
RESERVATION_OK = ("ok", "eligible", "valid", "platna", "platná", "confirmed")
PAYMENT_OK = ("paid online", "eligible", "paid", "uhrazeno online")


def normalize_booking(df: DataFrame, mapping: DataFrame, known: dict[str, tuple[str, ...]]) -> DataFrame:
    """df (reservation_status, payment_status, payment_id, paid_on, amount_minor) with error, eligible and reason.

    States are mapped to meanings (mapping: raw, meaning), else taken as they are; a meaning outside `known` for its
    column is an error, as are a missing payment id and day. A line is eligible if both states are good and its amount is not 0.
    """
    rows = apply_value_mapping(apply_value_mapping(df, mapping, "reservation_status", "__r"), mapping, "payment_status", "__p")
    rows = rows.withColumns({m: F.lower(F.trim(F.coalesce(F.col(m), F.col(c)))) for m, c in (("__r", "reservation_status"), ("__p", "payment_status"))})
    lost = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    error = F.when(lost("payment_id"), "NO_IDENTITY").when(lost("paid_on"), "NO_DAY").when(~F.col("__r").isin(*known["reservation_status"]), "UNKNOWN_RESERVATION_STATUS").when(~F.col("__p").isin(*known["payment_status"]), "UNKNOWN_PAYMENT_STATUS")
    reason = F.when(~F.col("__r").isin(*RESERVATION_OK), "RESERVATION_STATUS").when(~F.col("__p").isin(*PAYMENT_OK), "PAYMENT_STATUS").when(F.col("amount_minor") == 0, "ZERO_AMOUNT")
    rows = rows.withColumn("error", error).withColumn("reason", F.when(F.col("error").isNull(), F.coalesce(reason, F.lit("ELIGIBLE"))))
    return rows.withColumn("eligible", F.when(F.col("reason") == "ELIGIBLE", 1).otherwise(0)).drop("__r", "__p")


def import_counters(df: DataFrame, file: str) -> DataFrame:
    """A row for each file: rows seen, blank, summary, closure and ignored ones, errors, new ones and conflicts, and the
    amounts in each currency as JSON. df: kind, error, currency, amount_minor, outcome (of what would be stored)."""
    kind = lambda k: F.count_if((F.col("kind") == k) & F.col("error").isNull())
    stored = lambda o: F.count_if(F.col("outcome") == o)
    counts = df.groupBy(file).agg(F.count("*").alias("seen"), kind("BLANK").alias("blank"), kind("SUMMARY").alias("summary"), kind("CLOSURE").alias("closure"), kind("IGNORE").alias("ignored"), F.count("error").alias("errors"), stored("NEW").alias("new"), stored("IDENTICAL").alias("duplicate"), stored("CONFLICT").alias("conflict"))
    sums = df.where("error IS NULL AND kind IN ('SALE', 'REFUND')").groupBy(file, "currency").agg(F.sum("amount_minor").alias("minor"))
    totals = sums.groupBy(file).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "currency", F.col("minor").cast("string")))), " ").alias("totals"))
    return counts.join(totals, file, "left").withColumn("totals", F.coalesce("totals", F.lit("")))
