"""The registered queries of the library, each with the SQL that says the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters as C
from ..operators import groups as G
from ..operators import matching as M
from ..operators import search as X
from ..operators import state as T
from ..operators.scratch import scratch
from .adapters import ctes, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str, recursive: bool = False):
    """Registers a query; sql follows the WITH of the named derived tables."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            head = ctes(*tables) if tables else ""
            body = sql.strip()
            found = f"{head}{',' if body.startswith('+') else ''} {body.removeprefix('+')}" if head else body
            ORACLE_SQL[name] = found.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else found
        return f

    return add


# Sums of allocations, used by many.
USED = "u AS (SELECT invoice_id, CAST(SUM(amount_minor) AS BIGINT) AS used_minor FROM allocation WHERE active = 1 GROUP BY invoice_id)"


def used(spark, d):
    return read(spark, d, "allocation").where("active = 1").groupBy("invoice_id").agg(F.sum("amount_minor").alias("used_minor"))


def with_used(spark, d):
    return read(spark, d, "invoice").join(used(spark, d), "invoice_id", "left").withColumn("used_minor", F.coalesce("used_minor", F.lit(0).cast("bigint")))


STATUS_SQL = "CASE WHEN coalesce(used_minor, 0) = 0 THEN 'NEUHRAZEN' WHEN abs(used_minor) >= abs(total_minor) THEN 'UHRAZEN' ELSE 'ČÁSTEČNÁ ÚHRADA' END"


@query("g11_payment_status_summary", f"+{USED} SELECT currency, {STATUS_SQL} AS status, count(*) AS invoices, CAST(sum(total_minor) AS BIGINT) AS total_minor FROM invoice LEFT JOIN u USING (invoice_id) WHERE included = 1 AND pay_method = 2 AND paid_at IS NOT NULL GROUP BY ALL", "invoice", "allocation")
def g11_summary(spark, d):
    rows = with_used(spark, d).where("included = 1 AND pay_method = 2 AND paid_at IS NOT NULL")
    return rows.groupBy("currency", G.payment_status(F.col("total_minor"), F.col("used_minor")).alias("status")).agg(F.count("*").alias("invoices"), F.sum("total_minor").alias("total_minor"))


@query("g11_payment_status", f"+{USED} SELECT invoice_id, {STATUS_SQL} AS status FROM invoice LEFT JOIN u USING (invoice_id)", "invoice", "allocation")
def g11_status(spark, d):
    return with_used(spark, d).select("invoice_id", G.payment_status(F.col("total_minor"), F.col("used_minor")).alias("status"))


@query("j2_remaining", f"+{USED} SELECT invoice_id, total_minor - coalesce(used_minor, 0) AS remaining_minor FROM invoice LEFT JOIN u USING (invoice_id)", "invoice", "allocation")
def j2(spark, d):
    return with_used(spark, d).select("invoice_id", (F.col("total_minor") - F.col("used_minor")).alias("remaining_minor"))


@query("p10_controlled_invoices", "SELECT invoice_id, total_minor, currency FROM invoice WHERE included = 1 AND pay_method = 2 AND paid_at IS NOT NULL", "invoice")
def p10(spark, d):
    return read(spark, d, "invoice").where("included = 1 AND pay_method = 2 AND paid_at IS NOT NULL").select("invoice_id", "total_minor", "currency")


@query("p9_active_items", f"+{USED} SELECT invoice_id, total_minor - coalesce(used_minor, 0) AS remaining_minor FROM invoice LEFT JOIN u USING (invoice_id) WHERE included = 1 AND pay_method = 2 AND paid_at IS NOT NULL AND total_minor <> coalesce(used_minor, 0)", "invoice", "allocation")
def p9(spark, d):
    return M.active_invoices(read(spark, d, "invoice"), used(spark, d)).select("invoice_id", "remaining_minor")


ITEMS_SQL = "SELECT 'INVOICE' AS entity_type, invoice_id AS entity_id, 'DOCUMENT' AS side, total_minor AS amount_minor, currency, doc_date AS effective_date, booking_reference FROM invoice UNION ALL SELECT 'BOOKING', source_id, 'SOURCE', amount_minor, currency, paid_on, booking_reference FROM booking UNION ALL SELECT 'CARD', source_id, 'SOURCE', amount_minor, currency, paid_on, NULL FROM card"


def items(spark, d):
    cols = ["entity_type", "entity_id", "side", "amount_minor", "currency", "effective_date", "booking_reference"]
    inv = read(spark, d, "invoice").select(F.lit("INVOICE").alias("entity_type"), F.col("invoice_id").alias("entity_id"), F.lit("DOCUMENT").alias("side"), F.col("total_minor").alias("amount_minor"), "currency", F.col("doc_date").alias("effective_date"), "booking_reference")
    book, card = (read(spark, d, t).select(F.lit(t.upper()).alias("entity_type"), F.col("source_id").alias("entity_id"), F.lit("SOURCE").alias("side"), "amount_minor", "currency", F.col("paid_on").alias("effective_date"), *(["booking_reference"] if t == "booking" else [])) for t in ("booking", "card"))
    return inv.unionByName(book).unionByName(card, allowMissingColumns=True).select(*cols)


@query("p15_match_items", ITEMS_SQL, "invoice", "booking", "card")
def p15(spark, d):
    return items(spark, d)


@query("p11_filter_documents", "SELECT invoice_id, total_minor FROM invoice WHERE currency = 'EUR' AND total_minor > 0 AND booking_reference IS NOT NULL AND date_diff('day', doc_date, DATE '2001-12-31') <= 1500 AND doc_date <= DATE '2000-12-31'", "invoice")
def p11(spark, d):
    criteria = {"currency": "EUR", "amount_from": 1, "reference": True, "days": 1500, "to": "2000-12-31"}
    return C.filter_rows(read(spark, d, "invoice"), criteria, "DOCUMENT", F.lit("2001-12-31").cast("date")).select("invoice_id", "total_minor")


@query("p11_stored_filter", "SELECT invoice_id, total_minor FROM invoice WHERE total_minor < 0 AND total_minor >= -5000000 AND (CAST(code AS STRING) LIKE '%7%' OR invoice_id LIKE '%7%' OR internal_code LIKE '%7%' OR booking_reference LIKE '%7%')", "invoice")
def p11_stored(spark, d):
    """A filter as it is stored, in JSON, with a sort order; a text that is no JSON asks for nothing."""
    stored = '{"type": "CREDIT", "text": " 7 ", "amount_from": -5000000, "currency": "", "sort": ["-total_minor", "invoice_id"]}'
    rows = C.filter_rows(read(spark, d, "invoice"), "not JSON", "DOCUMENT")
    return C.filter_rows(rows, stored, "DOCUMENT").select("invoice_id", "total_minor")


@query("p12_filter_sources", "SELECT source_id, 'BOOKING' AS kind, amount_minor, currency FROM booking WHERE (booking_reference LIKE '%7%' OR payment_id LIKE '%7%') AND currency = 'CZK' AND paid_on >= DATE '1996-01-01' UNION ALL SELECT source_id, 'CARD', amount_minor, currency FROM card WHERE CAST(terminal AS STRING) LIKE '%7%' AND currency = 'CZK' AND paid_on >= DATE '1996-01-01' UNION ALL SELECT concat('K', CAST(movement_id AS STRING)), 'CASHBOOK', amount_minor, currency FROM movement WHERE kind = 'CASHBOOK' AND CAST(user_id AS STRING) LIKE '%7%' AND currency = 'CZK' AND day >= DATE '1996-01-01'", "booking", "card", "movement")
def p12(spark, d):
    cash = read(spark, d, "movement").where("kind = 'CASHBOOK'").select(F.concat(F.lit("K"), F.col("movement_id").cast("string")).alias("source_id"), "amount_minor", "currency", "day", F.col("user_id").alias("client"))
    return C.filter_sources({"BOOKING": read(spark, d, "booking"), "CARD": read(spark, d, "card"), "CASHBOOK": cash}, {"text": "7", "currency": "CZK", "from": "1996-01-01"})


@query("p4_booking_eligibility", "SELECT source_id, CASE WHEN status <> 'ok' THEN 'RESERVATION_STATUS' WHEN amount_minor = 0 THEN 'ZERO_AMOUNT' WHEN booking_reference IS NULL THEN 'NO_REFERENCE' ELSE 'ELIGIBLE' END AS reason FROM booking", "booking")
def p4(spark, d):
    reason = F.when(F.col("status") != "ok", "RESERVATION_STATUS").when(F.col("amount_minor") == 0, "ZERO_AMOUNT").when(F.col("booking_reference").isNull(), "NO_REFERENCE").otherwise("ELIGIBLE")
    return read(spark, d, "booking").select("source_id", reason.alias("reason"))


@query("j1_invoice_customer_nation", "SELECT invoice_id, c_name, n_name FROM invoice LEFT JOIN customer ON customer = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey", "invoice")
def j1(spark, d):
    rows = read(spark, d, "invoice").join(read(spark, d, "customer"), F.col("customer") == F.col("c_custkey"), "left")
    return rows.join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("invoice_id", "c_name", "n_name")


@query("j3_lines_with_batch", "+t AS (SELECT payment_id, paid_on, currency, count(*) AS lines, CAST(sum(amount_minor) AS BIGINT) AS batch_minor FROM booking GROUP BY ALL) SELECT source_id, lines, batch_minor FROM booking JOIN t USING (payment_id, paid_on, currency)", "booking")
def j3(spark, d):
    b = read(spark, d, "booking")
    return b.join(b.groupBy("payment_id", "paid_on", "currency").agg(F.count("*").alias("lines"), F.sum("amount_minor").alias("batch_minor")), ["payment_id", "paid_on", "currency"]).select("source_id", "lines", "batch_minor")


@query("j4_not_allocated", "SELECT invoice_id FROM invoice WHERE NOT EXISTS (SELECT 1 FROM allocation a WHERE a.invoice_id = invoice.invoice_id AND active = 1)", "invoice", "allocation")
def j4(spark, d):
    return read(spark, d, "invoice").join(read(spark, d, "allocation").where("active = 1"), "invoice_id", "left_anti").select("invoice_id")


@query("j5_locked_invoices", "SELECT invoice_id FROM invoice WHERE EXISTS (SELECT 1 FROM allocation a WHERE a.invoice_id = invoice.invoice_id AND active = 1 AND method = 'MANUAL')", "invoice", "allocation")
def j5(spark, d):
    return read(spark, d, "invoice").join(read(spark, d, "allocation").where("active = 1 AND method = 'MANUAL'"), "invoice_id", "left_semi").select("invoice_id")


@query("j6_cashbook_candidates", "SELECT c.movement_id, s.movement_id AS source_id, s.kind FROM movement c JOIN movement s ON c.currency = s.currency AND c.amount_minor = s.amount_minor AND abs(date_diff('day', c.day, s.day)) <= 2 WHERE c.kind = 'CASHBOOK' AND s.kind IN ('CARD', 'BOOKING')", "movement")
def j6(spark, d):
    m = read(spark, d, "movement")
    cash = m.where("kind = 'CASHBOOK'").select("movement_id", "currency", "amount_minor", F.col("day").alias("cash_day"))
    src = m.where("kind IN ('CARD', 'BOOKING')").select(F.col("movement_id").alias("source_id"), "kind", "currency", "amount_minor", F.col("day").alias("source_day"))
    return M.near_days(cash, src, "cash_day", "source_day", ["currency", "amount_minor"], 2).select("movement_id", "source_id", "kind")


DOC_SQL = "d AS (SELECT *, total_minor AS remaining_minor FROM invoice WHERE included = 1 AND pay_method = 2 AND paid_at IS NOT NULL)"
PAIR_SQL = "sign(d.remaining_minor) = sign(s.amount_minor) AND abs(date_diff('day', d.doc_date, s.paid_on)) <= 7"


@query("j7_reference_pairs", f"+{DOC_SQL} SELECT invoice_id, source_id FROM d JOIN booking s ON d.currency = s.currency AND d.booking_reference = s.booking_reference AND {PAIR_SQL}", "invoice", "booking")
def j7(spark, d):
    return M.reference_pairs(M.active_invoices(read(spark, d, "invoice")), read(spark, d, "booking")).select("invoice_id", "source_id")


def sources(spark, d):
    return read(spark, d, "booking").select("source_id", "amount_minor", "currency", "paid_on", F.col("booking_reference").alias("source_reference"), F.lit(1).alias("is_booking")).unionByName(read(spark, d, "card").select("source_id", "amount_minor", "currency", "paid_on", F.lit(None).cast("string").alias("source_reference"), F.lit(0).alias("is_booking")))


SRC_SQL = "s AS (SELECT source_id, amount_minor, currency, paid_on, booking_reference AS source_reference, 1 AS is_booking FROM booking UNION ALL SELECT source_id, amount_minor, currency, paid_on, NULL, 0 FROM card)"


@query("j8_amount_pairs", f"+{DOC_SQL}, {SRC_SQL} SELECT invoice_id, source_id FROM d JOIN s ON d.currency = s.currency AND abs(d.remaining_minor - s.amount_minor) <= 1 AND {PAIR_SQL}", "invoice", "booking", "card")
def j8(spark, d):
    return M.amount_pairs(M.active_invoices(read(spark, d, "invoice")), sources(spark, d)).select("invoice_id", "source_id")


def candidates(spark, d):
    docs = M.active_invoices(read(spark, d, "invoice")).withColumnRenamed("booking_reference", "doc_reference")
    cols = ["invoice_id", "source_id", "remaining_minor", "amount_minor", "currency", "doc_date", "paid_on", "paid_at", "doc_reference", "source_reference", "is_booking", "linked", "internal_code"]
    src = sources(spark, d)
    by_ref = M.reference_pairs(docs.withColumn("booking_reference", F.col("doc_reference")), src.withColumn("booking_reference", F.col("source_reference")))
    by_amount = M.amount_pairs(docs, src.withColumn("real_minor", F.col("amount_minor"))).withColumn("amount_minor", F.col("real_minor"))
    return by_ref.select(*cols).unionByName(by_amount.select(*cols)).dropDuplicates(["invoice_id", "source_id"])


CAND_SQL = f"""{DOC_SQL}, {SRC_SQL}, p AS (SELECT d.invoice_id, s.source_id, d.remaining_minor, s.amount_minor, d.paid_at, d.booking_reference AS doc_reference, s.source_reference, is_booking, d.linked, d.internal_code, d.currency, abs(date_diff('day', doc_date, paid_on)) AS days
    FROM d JOIN s ON d.currency = s.currency AND {PAIR_SQL} AND (d.booking_reference = s.source_reference OR abs(d.remaining_minor - s.amount_minor) <= 1))"""


@query("m1_pair_candidates", f"+{CAND_SQL} SELECT invoice_id, source_id FROM p", "invoice", "booking", "card")
def m1(spark, d):
    return candidates(spark, d).select("invoice_id", "source_id")


SAME_SQL = "is_booking = 1 AND source_reference IS NOT NULL AND (doc_reference IS NULL OR doc_reference = source_reference)"
POINTS_SQL = {
    "EXACT_AMOUNT": "CASE WHEN abs(remaining_minor - amount_minor) <= 1 THEN CASE WHEN is_booking = 1 THEN 15 ELSE 60 END END",
    "BOOKING_ID": f"CASE WHEN {SAME_SQL} THEN 45 END",
    "DIRECT_LINK": f"CASE WHEN {SAME_SQL} AND linked = 1 THEN 30 END",
    "INTERNAL_CODE": f"CASE WHEN {SAME_SQL} AND internal_code IS NOT NULL THEN 5 END",
    "BOOKING_CONFLICT": "CASE WHEN is_booking = 1 AND doc_reference <> source_reference THEN 0 END",
    "DATE": "CASE WHEN is_booking = 1 THEN CASE WHEN days <= 2 THEN 5 WHEN days <= 4 THEN 3 WHEN days <= 7 THEN 1 ELSE 0 END ELSE CASE WHEN days <= 2 THEN 25 WHEN days <= 4 THEN 18 WHEN days <= 7 THEN 10 ELSE 0 END END",
    "PAID_AT": "CASE WHEN is_booking = 0 AND paid_at IS NOT NULL THEN 5 END",
}
SCORE_SQL = f"{CAND_SQL}, q AS (SELECT *, CAST(least(100, {' + '.join(f'coalesce({x}, 0)' for x in POINTS_SQL.values())}) AS INTEGER) AS score, CASE WHEN is_booking = 1 AND doc_reference <> source_reference THEN 1 ELSE 0 END AS conflicting FROM p)"


@query("m3_scores", f"+{SCORE_SQL} SELECT invoice_id, source_id, score, conflicting FROM q", "invoice", "booking", "card")
def m3(spark, d):
    return M.scored_pairs(candidates(spark, d), F.col("is_booking") == 1).select("invoice_id", "source_id", "score", "conflicting")


EVIDENCE_SQL = "concat_ws(' ', " + ", ".join(f"'{k}:' || CAST({x} AS STRING)" for k, x in POINTS_SQL.items()) + ")"


@query("m3_evidence", f"+{SCORE_SQL} SELECT invoice_id, source_id, {EVIDENCE_SQL} AS evidence FROM q", "invoice", "booking", "card")
def m3_evidence(spark, d):
    b = F.col("is_booking") == 1
    shown = F.array_join(F.transform("evidence", lambda e: F.concat(e["code"], F.lit(":"), e["points"].cast("string"))), " ")
    return M.evidence(M.scored_pairs(candidates(spark, d), b), b).select("invoice_id", "source_id", shown.alias("evidence"))


@query("w6_candidate_order", f"+{SCORE_SQL} SELECT invoice_id, source_id, row_number() OVER (PARTITION BY invoice_id ORDER BY score DESC, abs(remaining_minor - amount_minor), days, least(invoice_id, source_id), greatest(invoice_id, source_id)) AS nth FROM q", "invoice", "booking", "card")
def w6(spark, d):
    rows = M.scored_pairs(candidates(spark, d), F.col("is_booking") == 1)
    return rows.select("invoice_id", "source_id", F.row_number().over(Window.partitionBy("invoice_id").orderBy(*M.candidate_order(rows))).alias("nth"))


DECIDED_SQL = f"""{SCORE_SQL}, r AS (SELECT * REPLACE (CAST(least(100, score + CASE WHEN is_booking = 0 AND count(*) OVER (PARTITION BY invoice_id) = 1 AND count(*) OVER (PARTITION BY source_id) = 1 THEN 10 ELSE 0 END) AS INTEGER) AS score) FROM q),
    o AS (SELECT *, coalesce((SELECT max(score) FROM r x WHERE (x.invoice_id = r.invoice_id AND x.source_id <> r.source_id) OR (x.source_id = r.source_id AND x.invoice_id <> r.invoice_id)), 0) AS competitor FROM r),
    v AS (SELECT *, CASE WHEN score >= 95 AND score - competitor >= 15 AND abs(remaining_minor - amount_minor) <= 1 AND conflicting = 0 THEN 1 ELSE 0 END AS can_auto FROM o)"""


@query("m5_decisions", f"+{DECIDED_SQL} SELECT invoice_id, source_id, score, competitor, can_auto FROM v", "invoice", "booking", "card")
def m5(spark, d):
    b = F.col("is_booking") == 1
    return M.decided(M.scored_pairs(candidates(spark, d), b), b).select("invoice_id", "source_id", "score", "competitor", "can_auto")


@query("m3_full_evidence", f"+{DECIDED_SQL}, n AS (SELECT invoice_id, source_id, is_booking = 0 AND count(*) OVER (PARTITION BY invoice_id) = 1 AND count(*) OVER (PARTITION BY source_id) = 1 AS alone FROM q), e AS (SELECT invoice_id, source_id, {EVIDENCE_SQL} AS evidence FROM q) SELECT invoice_id, source_id, v.score, evidence || CASE WHEN alone THEN ' UNIQUE:10' ELSE '' END AS evidence FROM v JOIN n USING (invoice_id, source_id) JOIN e USING (invoice_id, source_id)", "invoice", "booking", "card")
def m3_full(spark, d):
    """All evidence of the final score, with that of uniqueness."""
    b = F.col("is_booking") == 1
    rows = M.unique_evidence(M.decided(M.evidence(M.scored_pairs(candidates(spark, d), b), b), b), b)
    shown = F.array_join(F.transform("evidence", lambda e: F.concat(e["code"], F.lit(":"), e["points"].cast("string"))), " ")
    return rows.select("invoice_id", "source_id", "score", shown.alias("evidence"))


@query("j11_shared_sources", "SELECT DISTINCT a.invoice_id, b.invoice_id AS other_id FROM allocation a JOIN allocation b ON a.source_id = b.source_id AND a.made_on = b.made_on AND a.invoice_id <> b.invoice_id WHERE a.active = 1 AND b.active = 1", "allocation")
def j11(spark, d):
    a = read(spark, d, "allocation").where("active = 1").select("invoice_id", "source_id", "made_on").distinct()
    b = a.withColumnRenamed("invoice_id", "other_id")
    return a.join(b, ["source_id", "made_on"]).where("invoice_id <> other_id").select("invoice_id", "other_id").distinct()


@query("a3_kpi_counts", f"""+{USED}, k AS (SELECT currency, 'DOCUMENTS' AS kpi, count(*) AS n FROM invoice GROUP BY ALL UNION ALL SELECT currency, 'BOOKING', count(*) FROM booking GROUP BY ALL UNION ALL SELECT currency, 'CARDS', count(*) FROM card GROUP BY ALL
    UNION ALL SELECT currency, {STATUS_SQL}, count(*) FROM invoice LEFT JOIN u USING (invoice_id) GROUP BY ALL) SELECT * FROM k""", "invoice", "booking", "card", "allocation")
def a3(spark, d):
    parts = [read(spark, d, t).groupBy("currency").agg(F.count("*").alias("n")).select("currency", F.lit(k).alias("kpi"), "n") for t, k in (("invoice", "DOCUMENTS"), ("booking", "BOOKING"), ("card", "CARDS"))]
    status = with_used(spark, d).groupBy("currency", G.payment_status(F.col("total_minor"), F.col("used_minor")).alias("kpi")).agg(F.count("*").alias("n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(status)


BANDS = [("0-2", 0, 2), ("3-7", 3, 7), ("8-30", 8, 30), ("31-90", 31, 90), ("91+", 91, 10**6)]


@query("a4_aging", "+b(band, lo, hi) AS (VALUES " + ", ".join(map(str, BANDS)) + f"), {USED} SELECT band, count(invoice_id) AS invoices FROM b LEFT JOIN (SELECT invoice_id, date_diff('day', doc_date, (SELECT max(doc_date) FROM invoice)) AS age FROM invoice LEFT JOIN u USING (invoice_id) WHERE total_minor <> coalesce(used_minor, 0)) o ON age BETWEEN lo AND hi GROUP BY band", "invoice", "allocation")
def a4(spark, d):
    last = read(spark, d, "invoice").agg(F.max("doc_date")).scalar()
    age = F.datediff(last, "doc_date")
    band = F.when(age <= 2, "0-2").when(age <= 7, "3-7").when(age <= 30, "8-30").when(age <= 90, "31-90").otherwise("91+")
    counts = with_used(spark, d).where("total_minor <> used_minor").groupBy(band.alias("band")).agg(F.count("*").alias("invoices"))
    every = spark.createDataFrame([(b[0],) for b in BANDS], "band string")
    return every.join(counts, "band", "left").select("band", F.coalesce("invoices", F.lit(0)).alias("invoices"))


@query("a5_import_counters", "SELECT kind, currency, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS total_minor FROM movement GROUP BY ALL", "movement")
def a5(spark, d):
    return read(spark, d, "movement").groupBy("kind", "currency").agg(F.count("*").alias("n"), F.sum("amount_minor").alias("total_minor"))


@query("a7_reference_lists", "SELECT customer, string_agg(booking_reference, ',' ORDER BY booking_reference) AS refs FROM (SELECT DISTINCT customer, booking_reference FROM invoice WHERE booking_reference IS NOT NULL) GROUP BY customer", "invoice")
def a7(spark, d):
    return read(spark, d, "invoice").where("booking_reference IS NOT NULL").groupBy("customer").agg(F.array_join(F.sort_array(F.collect_set("booking_reference")), ",").alias("refs"))


@query("a8_signed_contributions", "SELECT user_id AS selection, currency, CAST(sum(CASE kind WHEN 'CASHBOOK' THEN amount_minor WHEN 'OTHER' THEN 0 ELSE -amount_minor END) AS BIGINT) AS contribution_minor, count(DISTINCT kind) AS kinds FROM movement GROUP BY ALL", "movement")
def a8(spark, d):
    signed = F.when(F.col("kind") == "CASHBOOK", F.col("amount_minor")).when(F.col("kind") == "OTHER", 0).otherwise(-F.col("amount_minor"))
    return read(spark, d, "movement").groupBy(F.col("user_id").alias("selection"), "currency").agg(F.sum(signed).alias("contribution_minor"), F.count_distinct("kind").alias("kinds"))


@query("a11_freshness", "SELECT 'BOOKING' AS source, max(paid_on) AS last_day FROM booking UNION ALL SELECT 'CARD', max(paid_on) FROM card UNION ALL SELECT 'MOVEMENT', max(day) FROM movement", "booking", "card", "movement")
def a11(spark, d):
    rows = read(spark, d, "booking").select(F.lit("BOOKING").alias("source"), F.col("paid_on").alias("day")).unionByName(read(spark, d, "card").select(F.lit("CARD").alias("source"), F.col("paid_on").alias("day"))).unionByName(read(spark, d, "movement").select(F.lit("MOVEMENT").alias("source"), "day"))
    return rows.groupBy("source").agg(F.max("day").alias("last_day"))


@query("w1_first_reference", "SELECT customer, arg_min(booking_reference, invoice_id) AS first_reference FROM invoice WHERE booking_reference IS NOT NULL GROUP BY customer", "invoice")
def w1(spark, d):
    return read(spark, d, "invoice").where("booking_reference IS NOT NULL").groupBy("customer").agg(F.min_by("booking_reference", "invoice_id").alias("first_reference"))


@query("w2_latest_movement", "SELECT user_id, movement_id, amount_minor FROM movement QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, movement_id DESC) = 1", "movement")
def w2(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("movement_id"))
    return read(spark, d, "movement").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "movement_id", "amount_minor")


@query("w3_latest_line", "SELECT payment_id, source_id FROM booking QUALIFY row_number() OVER (PARTITION BY payment_id ORDER BY paid_on DESC, source_id) = 1", "booking")
def w3(spark, d):
    w = Window.partitionBy("payment_id").orderBy(F.desc("paid_on"), "source_id")
    return read(spark, d, "booking").withColumn("n", F.row_number().over(w)).where("n = 1").select("payment_id", "source_id")


@query("w8_date_islands", "SELECT invoice_id, CAST(sum(new) OVER (PARTITION BY customer ORDER BY doc_date RANGE UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (SELECT invoice_id, customer, doc_date, CASE WHEN date_diff('day', lag(doc_date) OVER (PARTITION BY customer ORDER BY doc_date), doc_date) <= 30 THEN 0 ELSE 1 END AS new FROM invoice)", "invoice")
def w8(spark, d):
    return M.islands(read(spark, d, "invoice"), ["customer"], "doc_date", 30).select("invoice_id", "island")


@query("o1_top_counterparts", f"+{SRC_SQL}, j AS (SELECT invoice_id, source_id, abs(total_minor - amount_minor) AS diff FROM invoice d JOIN s ON d.currency = s.currency AND d.booking_reference = s.source_reference AND sign(total_minor) = sign(amount_minor) AND abs(date_diff('day', doc_date, paid_on)) <= 30) SELECT invoice_id, source_id, diff FROM j QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY diff, source_id) <= 3", "invoice", "booking", "card")
def o1(spark, d):
    inv = read(spark, d, "invoice")
    src = read(spark, d, "booking").where("booking_reference IS NOT NULL")
    j = M.near_days(inv.where("booking_reference IS NOT NULL"), src, "doc_date", "paid_on", ["currency", "booking_reference"], 30).where("signum(total_minor) = signum(amount_minor)")
    j = j.withColumn("diff", F.abs(F.col("total_minor") - F.col("amount_minor")))
    return j.withColumn("n", F.row_number().over(Window.partitionBy("invoice_id").orderBy("diff", "source_id"))).where("n <= 3").select("invoice_id", "source_id", "diff")


@query("o2_largest_open", f"+{USED} SELECT invoice_id, total_minor - coalesce(used_minor, 0) AS open_minor FROM invoice LEFT JOIN u USING (invoice_id) WHERE total_minor <> coalesce(used_minor, 0) ORDER BY abs(open_minor) DESC, invoice_id LIMIT 100", "invoice", "allocation")
def o2(spark, d):
    rows = with_used(spark, d).select("invoice_id", (F.col("total_minor") - F.col("used_minor")).alias("open_minor")).where("open_minor <> 0")
    return rows.orderBy(F.desc(F.abs("open_minor")), "invoice_id").limit(100)


@query("u2_correlation_ids", "SELECT payment_id AS id FROM booking UNION SELECT concat('T', CAST(terminal AS STRING)) FROM card UNION SELECT concat('U', CAST(user_id AS STRING)) FROM movement", "booking", "card", "movement")
def u2(spark, d):
    return read(spark, d, "booking").select(F.col("payment_id").alias("id")).union(read(spark, d, "card").select(F.concat(F.lit("T"), F.col("terminal").cast("string")))).union(read(spark, d, "movement").select(F.concat(F.lit("U"), F.col("user_id").cast("string")))).distinct()


@query("u3_work_list", f"+i AS ({ITEMS_SQL}) SELECT entity_type, entity_id, amount_minor FROM i WHERE NOT EXISTS (SELECT 1 FROM allocation a WHERE a.active = 1 AND a.invoice_id = i.entity_id)", "invoice", "booking", "card", "allocation")
def u3(spark, d):
    taken = read(spark, d, "allocation").where("active = 1").select(F.col("invoice_id").alias("entity_id"))
    return items(spark, d).join(taken, "entity_id", "left_anti").select("entity_type", "entity_id", "amount_minor")


@query("m9_waterfall", """+d AS (SELECT customer AS k, currency, sign(total_minor) AS sg, invoice_id AS doc, abs(total_minor) AS amount FROM invoice WHERE total_minor <> 0), s AS (SELECT CAST(substr(payment_id, 2) AS BIGINT) AS k, currency, sign(amount_minor) AS sg, source_id AS src, abs(amount_minor) AS amount FROM booking WHERE amount_minor <> 0),
    dd AS (SELECT *, sum(amount) OVER (PARTITION BY k, currency, sg ORDER BY doc) AS hi FROM d), ss AS (SELECT *, sum(amount) OVER (PARTITION BY k, currency, sg ORDER BY src) AS hi FROM s)
    SELECT dd.k AS customer, dd.currency, doc, src, CAST(dd.sg * (least(dd.hi, ss.hi) - greatest(dd.hi - dd.amount, ss.hi - ss.amount)) AS BIGINT) AS amount FROM dd JOIN ss ON dd.k = ss.k AND dd.currency = ss.currency AND dd.sg = ss.sg AND greatest(dd.hi - dd.amount, ss.hi - ss.amount) < least(dd.hi, ss.hi)""", "invoice", "booking")
def m9(spark, d):
    """Every currency and sign by itself."""
    side = lambda df, key, name, amount: df.where(F.col(amount) != 0).select(F.expr(key).alias("customer"), "currency", F.signum(amount).cast("int").alias("sign"), F.col({"doc": "invoice_id", "src": "source_id"}[name]).alias(name), F.abs(amount).alias("amount"))
    rows = M.waterfall(side(read(spark, d, "invoice"), "customer", "doc", "total_minor"), side(read(spark, d, "booking"), "CAST(substr(payment_id, 2) AS BIGINT)", "src", "amount_minor"), ["customer", "currency", "sign"])
    return rows.select("customer", "currency", "doc", "src", (F.col("amount") * F.col("sign")).alias("amount"))


@query("m12_allocation_violations", f"+{USED} SELECT invoice_id, used_minor, CASE WHEN sign(used_minor) <> sign(total_minor) THEN 'SIGN' ELSE 'ABOVE_TOTAL' END AS reason FROM invoice JOIN u USING (invoice_id) WHERE sign(used_minor) <> sign(total_minor) OR abs(used_minor) > abs(total_minor)", "invoice", "allocation")
def m12(spark, d):
    rows = read(spark, d, "invoice").join(used(spark, d), "invoice_id")
    sign = F.signum("used_minor") != F.signum("total_minor")
    return rows.where(sign | (F.abs("used_minor") > F.abs("total_minor"))).select("invoice_id", "used_minor", F.when(sign, "SIGN").otherwise("ABOVE_TOTAL").alias("reason"))


#: Cash rows of a key in order, each with its candidates; what earlier ones took is carried along.
REPLAY_SQL = """+c AS (SELECT movement_id, currency, amount_minor, day, row_number() OVER (PARTITION BY currency, amount_minor ORDER BY ts, movement_id) AS n FROM movement WHERE kind = 'CASHBOOK'),
    k AS (SELECT c.movement_id, c.currency, c.amount_minor, c.n, coalesce(list(s.movement_id) FILTER (s.movement_id IS NOT NULL), []) AS near FROM c LEFT JOIN movement s ON s.kind IN ('CARD', 'BOOKING') AND s.currency = c.currency AND s.amount_minor = c.amount_minor AND abs(date_diff('day', c.day, s.day)) <= 2 GROUP BY ALL),
    r AS (SELECT currency, amount_minor, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS movement_id, CAST([] AS BIGINT[]) AS free, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT currency, amount_minor FROM c)
          UNION ALL SELECT currency, amount_minor, n, movement_id, free, CASE WHEN len(free) = 1 THEN list_concat(used, free) ELSE used END FROM (SELECT k.currency, k.amount_minor, k.n, k.movement_id, list_filter(k.near, lambda x: NOT list_contains(r.used, x)) AS free, r.used FROM r JOIN k ON k.currency = r.currency AND k.amount_minor = r.amount_minor AND k.n = r.n + 1))
    SELECT movement_id, CASE len(free) WHEN 0 THEN 'NONE' WHEN 1 THEN 'MATCHED' ELSE 'SEVERAL' END AS outcome, CASE WHEN len(free) = 1 THEN free[1] END AS source_id FROM r WHERE n > 0"""


@query("m13_auto_reconcile_cashbook", REPLAY_SQL, "movement", recursive=True)
def m13(spark, d):
    m = read(spark, d, "movement")
    return M.reconcile_cashbook(m.where("kind = 'CASHBOOK'"), m.where("kind IN ('CARD', 'BOOKING')"))


@query("m14_auto_match_documents")
def m14(spark, d):
    docs = M.active_invoices(read(spark, d, "invoice"), used(spark, d)).select("invoice_id", "currency", "booking_reference", "remaining_minor", "doc_date", "paid_at")
    lines, cards = (read(spark, d, t) for t in ("booking", "card"))
    return M.match_documents(docs, lines, cards)


@query("g12_payment_alerts")
def g12(spark, d):
    return M.payment_alerts(m14(spark, d))


@query("m19_run_summary", f"+{DECIDED_SQL}, z AS (SELECT invoice_id, count(*) AS n, CAST(sum(can_auto) AS BIGINT) AS groups FROM v GROUP BY invoice_id) SELECT currency, count(*) AS analysed, count(n) AS with_candidate, count(*) FILTER (groups > 0) AS settled, CAST(coalesce(sum(groups), 0) AS BIGINT) AS groups, count(*) - count(*) FILTER (groups > 0) AS remaining FROM d LEFT JOIN z USING (invoice_id) GROUP BY currency", "invoice", "booking", "card")
def m19(spark, d):
    b = F.col("is_booking") == 1
    per = M.decided(M.scored_pairs(candidates(spark, d), b), b).groupBy("invoice_id").agg(F.count("*").alias("n"), F.sum("can_auto").alias("groups"))
    rows = M.active_invoices(read(spark, d, "invoice")).join(per, "invoice_id", "left").groupBy("currency")
    return rows.agg(F.count("*").alias("analysed"), F.count("n").alias("with_candidate"), F.count_if(F.col("groups") > 0).alias("settled"), F.coalesce(F.sum("groups"), F.lit(0)).alias("groups"), (F.count("*") - F.count_if(F.col("groups") > 0)).alias("remaining"))


@query("t1_dedupe_identity", "SELECT l_orderkey, l_linenumber, count(*) AS seen, count(DISTINCT sha256(concat(CAST(l_partkey AS STRING), '|', CAST(l_suppkey AS STRING)))) AS contents, CASE WHEN contents > 1 THEN 'CONFLICT' WHEN seen > 1 THEN 'DUPLICATE' ELSE 'UNIQUE' END AS outcome FROM lineitem GROUP BY ALL")
def t1(spark, d):
    rows = read(spark, d, "lineitem").withColumn("content", S.sha256_text(F.col("l_partkey"), F.col("l_suppkey")))
    return T.dedupe_identity(rows, ["l_orderkey", "l_linenumber"], "content")


@query("t2_classify_new", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'NEW' WHEN o_orderkey % 5 = 0 THEN 'CONFLICT' ELSE 'IDENTICAL' END AS outcome FROM orders")
def t2(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", S.sha256_text(F.col("o_custkey"), F.col("o_orderstatus")).alias("content"))
    store = o.where("o_orderkey % 7 <> 0").withColumn("content", F.when(F.col("o_orderkey") % 5 == 0, "other").otherwise(F.col("content")))
    return T.classify_new(o, store, "o_orderkey", "content").select("o_orderkey", "outcome")


@query("t5_payout_batches", "SELECT payment_id, paid_on, currency, sha256(concat(payment_id, '|', CAST(paid_on AS STRING), '|', currency)) AS natural_key, count(*) AS lines, min(source_id) AS first_line FROM booking GROUP BY ALL", "booking")
def t5(spark, d):
    b = read(spark, d, "booking").groupBy("payment_id", "paid_on", "currency").agg(F.count("*").alias("lines"), F.min("source_id").alias("first_line"))
    return b.withColumn("natural_key", S.sha256_text(F.col("payment_id"), F.col("paid_on"), F.col("currency")))


@query("t6_upsert_orders", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN o_orderkey % 11 = 0 THEN 3 WHEN o_orderkey % 5 = 0 AND o_orderstatus <> 'X' THEN 4 ELSE 3 END AS row_version, CASE WHEN o_orderkey % 7 = 0 THEN 'INSERTED' WHEN o_orderkey % 11 = 0 THEN 'KEPT' WHEN o_orderkey % 5 = 0 THEN 'UPDATED' ELSE 'UNCHANGED' END AS outcome FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders)")
def t6(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("NOT (o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0)")
    old = o.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("row_version", F.lit(3))
    return T.upsert(new, old, "o_orderkey", ["o_orderstatus"])


@query("t9_incremental_window", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR")
def t9(spark, d):
    e = read(spark, d, "events")
    return e.where(F.col("ts") >= e.agg(F.max("ts")).scalar() - F.expr("INTERVAL 48 HOURS")).select("event_id")


@query("t9_incremental_run", "SELECT event_id FROM events, (SELECT max(ts) FILTER (event_id % 7 <> 0 AND event_id % 3 = 0) AS since FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 240 HOUR) c WHERE ts >= since - INTERVAL 168 HOUR AND NOT (ts < (SELECT max(ts) FROM events) - INTERVAL 240 HOUR AND event_id % 7 <> 0 AND event_id % 3 = 0)")
def t9_run(spark, d):
    """A second run that reads again from 168 hours before the first one's stored checkpoint; what it has taken is not new."""
    e = read(spark, d, "events").select("event_id", "ts", "value")
    first = e.where((F.col("ts") < e.agg(F.max("ts")).scalar() - F.expr("INTERVAL 240 HOURS")) & F.expr("event_id % 7 <> 0 AND event_id % 3 = 0"))
    folder = scratch(spark, "checkpoints")
    T.store_checkpoint(first, "ts", "events", folder)
    again = T.incremental_window(e, "ts", T.stored_checkpoint(spark, "events", folder), 168)
    content = lambda df: df.withColumn("content", S.sha256_text(F.col("event_id"), F.col("value")))
    return T.classify_new(content(again), content(first), "event_id", "content").where("outcome = 'NEW'").select("event_id")


@query("t12_date_blocks", "+m AS (SELECT min(doc_date) AS lo, max(doc_date) AS hi FROM invoice) SELECT CAST(b AS DATE) AS first_day, least(CAST(b AS DATE) + 30, hi) AS last_day FROM m, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 31 DAY)) AS t(b)", "invoice")
def t12(spark, d):
    m = read(spark, d, "invoice").agg(F.min("doc_date").alias("lo"), F.max("doc_date").alias("hi"))
    return m.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 31 DAYS"))).alias("first_day"), "hi").select("first_day", F.least(F.date_add("first_day", 30), "hi").alias("last_day"))


GROUP_SQL = "g AS (SELECT group_id, CAST(sum(CASE WHEN side = 'DOCUMENT' THEN amount_minor ELSE 0 END) AS BIGINT) AS document_minor, CAST(sum(CASE WHEN side = 'DOCUMENT' THEN 0 ELSE amount_minor END) AS BIGINT) AS source_minor, count(DISTINCT currency) AS currencies, count(*) AS members, min(CAST(method = 'AUTO' AS INTEGER)) AS all_auto FROM membership GROUP BY group_id), t AS (SELECT *, document_minor - source_minor AS difference_minor FROM g)"


@query("g1_group_totals", f"+{GROUP_SQL} SELECT * FROM t", "membership")
def g1(spark, d):
    return G.group_totals(read(spark, d, "membership"))


@query("g3_group_status", f"+{GROUP_SQL} SELECT group_id, CASE WHEN group_id % 2 = 0 THEN CASE WHEN difference_minor = 0 THEN 'AGGREGATE_MATCHED' WHEN difference_minor > 0 THEN 'UNDERPAID' ELSE 'OVERPAID' END WHEN difference_minor = 0 THEN CASE WHEN all_auto = 1 THEN 'AUTO_MATCHED' ELSE 'MANUAL_MATCHED' END WHEN source_minor = 0 THEN 'UNMATCHED' WHEN document_minor = 0 THEN 'PARTIAL' WHEN difference_minor > 0 THEN 'UNDERPAID' ELSE 'OVERPAID' END AS status FROM t", "membership")
def g3(spark, d):
    mode = F.when(F.col("group_id") % 2 == 0, "AGGREGATE").otherwise("DETAILED")
    return G.group_totals(read(spark, d, "membership")).select("group_id", G.group_status(mode).alias("status"))


def group_edges(m):
    """(parent, child) of every group and of the keys above it."""
    up = lambda i: F.floor(F.col("group_id") / F.pow(F.lit(10), i)).cast("bigint")
    steps = m.where("group_id >= 10").select("group_id").distinct().select("group_id", F.explode(F.sequence(F.lit(1), F.length(F.col("group_id").cast("string")) - 1)).alias("i"))
    return steps.select(up(F.col("i")).alias("parent"), up(F.col("i") - 1).alias("child")).distinct()


@query("g5_tree_rollup", f"+{GROUP_SQL}, e AS (SELECT CAST(floor(group_id / pow(10, i)) AS BIGINT) AS root, group_id FROM t, unnest(generate_series(0, length(CAST(group_id AS STRING)) - 1)) AS s(i)) SELECT e.root, CAST(sum(t.difference_minor) AS BIGINT) AS difference_minor, count(*) AS groups FROM e JOIN t USING (group_id) GROUP BY e.root", "membership")
def g5(spark, d):
    """A group's parent is its key without the last digit, down to one digit; a parent need not be a group itself."""
    m = read(spark, d, "membership")
    return G.tree_rollup(group_edges(m), G.group_totals(m).select("group_id", "difference_minor"))


@query("g7_membership_from_log", """+l AS (SELECT event_id AS seq, user_id AS group_id, CAST(CAST(ROUND(value) AS BIGINT) % 20 AS STRING) AS member, CAST(FLOOR(event_id / 3) AS BIGINT) AS command_id, CASE event_type WHEN 'purchase' THEN 'ADD' WHEN 'view' THEN 'ADD' WHEN 'click' THEN 'REMOVE' WHEN 'error' THEN 'UNDO' ELSE 'REDO' END AS action FROM events),
    f AS (SELECT *, first_value(action) OVER (PARTITION BY command_id ORDER BY seq DESC) AS latest FROM l), x AS (SELECT *, row_number() OVER (PARTITION BY group_id, member ORDER BY seq DESC) AS n FROM f WHERE latest <> 'UNDO' AND action NOT IN ('UNDO', 'REDO')) SELECT group_id, member FROM x WHERE n = 1 AND action = 'ADD'""", "movement")
def g7(spark, d):
    action = F.when(F.col("event_type").isin("purchase", "view"), "ADD").when(F.col("event_type") == "click", "REMOVE").when(F.col("event_type") == "error", "UNDO").otherwise("REDO")
    log = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("group_id"), (F.round("value").cast("bigint") % 20).cast("string").alias("member"), F.floor(F.col("event_id") / 3).alias("command_id"), action.alias("action"))
    return G.membership_from_log(log)


@query("g13_invariants", "SELECT 'CURRENCIES' AS rule, CAST(group_id AS STRING) AS object FROM membership GROUP BY group_id HAVING count(DISTINCT currency) > 1 UNION ALL SELECT 'OWNERS', member FROM membership GROUP BY member HAVING count(DISTINCT group_id) > 1", "membership")
def g13(spark, d):
    return G.violations(read(spark, d, "membership"))


@query("g14_object_history", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def g14(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 50").select("user_id", "event_id")


@query("s12_card_paid_invoices", f"+{USED} SELECT invoice_id, total_minor, currency, c_name, coalesce(booking_reference, '') AS refs, coalesce(used_minor, 0) AS used_minor FROM invoice LEFT JOIN u USING (invoice_id) LEFT JOIN customer ON customer = c_custkey WHERE included = 1 AND pay_method = 2 AND paid_at IS NOT NULL", "invoice", "allocation")
def s12(spark, d):
    rows = with_used(spark, d).where("included = 1 AND pay_method = 2 AND paid_at IS NOT NULL").join(read(spark, d, "customer"), F.col("customer") == F.col("c_custkey"), "left")
    return rows.select("invoice_id", "total_minor", "currency", "c_name", F.coalesce("booking_reference", F.lit("")).alias("refs"), "used_minor")


@query("s13_payments_report", "SELECT source_id, paid_on, amount_minor, currency FROM booking WHERE status = 'ok' UNION ALL SELECT source_id, paid_on, amount_minor, currency FROM card", "booking", "card")
def s13(spark, d):
    cols = ["source_id", "paid_on", "amount_minor", "currency"]
    return read(spark, d, "booking").where("status = 'ok'").select(*cols).unionByName(read(spark, d, "card").select(*cols)).orderBy("paid_on", "source_id")


@query("s15_group_proof", "SELECT group_id, member, CAST(sum(CASE WHEN side = 'DOCUMENT' THEN amount_minor ELSE -amount_minor END) AS BIGINT) AS contribution_minor, grouping(member) AS total_line FROM membership GROUP BY GROUPING SETS ((group_id, member), (group_id))", "membership")
def s15(spark, d):
    signed = F.when(F.col("side") == "DOCUMENT", F.col("amount_minor")).otherwise(-F.col("amount_minor"))
    rows = read(spark, d, "membership").withColumn("signed", signed)
    return rows.groupingSets([["group_id", "member"], ["group_id"]], "group_id", "member").agg(F.sum("signed").alias("contribution_minor"), F.grouping("member").cast("int").alias("total_line"))


@query("s10_csv_safe", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('''=', p_name) WHEN p_partkey % 3 = 1 THEN concat('''+', p_name) ELSE p_name END AS cell FROM part")
def s10(spark, d):
    cell = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("="), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("+"), "p_name")).otherwise(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", S.csv_safe(cell).alias("cell"))


@query("s4_parse_invoice_json", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE 1 END * CAST(ROUND(o_totalprice * 100) AS BIGINT) AS total_minor, CASE WHEN o_custkey % 3 = 0 THEN 'EUR' ELSE 'CZK' END AS currency FROM orders")
def s4(spark, d):
    o = read(spark, d, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.round("o_totalprice", 2).cast("decimal(20,2)").cast("string").alias("total"), F.when(F.col("o_custkey") % 3 == 0, 2).otherwise(1).alias("currency"), F.when(F.col("o_orderkey") % 17 == 0, 3).otherwise(1).alias("print_format"))).alias("payload"))
    p = o.select(F.from_json("payload", "id BIGINT, total STRING, currency INT, print_format INT").alias("p")).select("p.*")
    minor = S.to_minor(S.parse_decimal(F.col("total")))
    return p.select("id", F.when(F.col("print_format") == 3, -F.abs(minor)).otherwise(minor).alias("total_minor"), F.when(F.col("currency") == 2, "EUR").when(F.col("currency") == 1, "CZK").alias("currency"))


@query("f3_parse_decimal", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 2 THEN -1 ELSE 1 END * CAST(ROUND(o_totalprice * 100) AS BIGINT) AS BIGINT) AS minor FROM orders")
def f3(spark, d):
    o = read(spark, d, "orders").withColumn("v", F.round("o_totalprice", 2).cast("decimal(20,2)"))
    grouped = F.format_number("v", 2)
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.translate(grouped, ",.", " ,"), F.lit(" CZK"))).when(F.col("o_orderkey") % 4 == 1, F.concat(grouped, F.lit(" €"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("("), F.translate(grouped, ",.", ".,"), F.lit(")"))).otherwise(F.replace(F.col("v").cast("string"), F.lit("."), F.lit(",")))
    return o.select("o_orderkey", S.to_minor(S.parse_decimal(text)).alias("minor"))


@query("f7_parse_czech_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def f7(spark, d):
    o = read(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    names = F.array(*[F.lit(n) for n in ("ledna", "února", "března", "dubna", "května", "června", "července", "srpna", "září", "října", "listopadu", "prosince")])
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("day", "dd.MM.yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format("day", "d. M. yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format("day", "yyyy-MM-dd")).otherwise(F.concat(F.dayofmonth("day").cast("string"), F.lit(". "), F.get(names, F.month("day") - 1), F.lit(" "), F.year("day").cast("string")))
    return o.select("o_orderkey", S.parse_czech_date(text).alias("day"))


@query("f13_content_hash", "SELECT o_orderkey, sha256(concat(CAST(o_custkey AS STRING), '|', o_orderstatus, '|', o_orderpriority)) AS content_hash FROM orders")
def f13(spark, d):
    return read(spark, d, "orders").select("o_orderkey", S.sha256_text(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("content_hash"))


@query("f12_canonical_json", "SELECT o_orderkey, concat('{\"custkey\":', CAST(o_custkey AS STRING), ',\"orderkey\":', CAST(o_orderkey AS STRING), ',\"status\":\"', o_orderstatus, '\"}') AS json FROM orders")
def f12(spark, d):
    return read(spark, d, "orders").select("o_orderkey", S.canonical_json(orderkey=F.col("o_orderkey"), custkey=F.col("o_custkey"), status=F.col("o_orderstatus")).alias("json"))


LABELS = ["Original ID: ", "Channel reservation id ", "OriginalID=", "original id", "CHANNEL RESERVATION ID:"]


def label(n):
    return F.get(F.array(*[F.lit(x) for x in LABELS]), n % len(LABELS))


@query("f16_booking_reference", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN CAST(1000000 + conv_id AS STRING) WHEN turn % 3 = 1 THEN concat(CAST(1000000 + conv_id AS STRING), ',', '98765432', lpad(CAST(conv_id AS STRING), 12, '0')) ELSE '' END AS refs, CASE WHEN turn % 3 = 0 THEN 'CONFIRMED' WHEN turn % 3 = 1 THEN 'CONFLICT' ELSE 'MISSING' END AS status FROM conversations")
def f16(spark, d):
    c = read(spark, d, "conversations")
    long = F.concat(F.lit("98765432"), F.lpad(F.col("conv_id").cast("string"), 12, "0"))
    note = lambda n, ref: F.concat(F.lit("<p>"), label(F.col("conv_id").cast("int") + n), ref, F.lit("</p>&nbsp;Original ID: 12345<br>"), F.coalesce("text", F.lit("")))
    own = (F.lit(1000000) + F.col("conv_id")).cast("string")
    notes = F.when(F.col("turn") % 3 == 0, F.array(note(0, own), note(1, own))).when(F.col("turn") % 3 == 1, F.array(note(2, own), note(3, long))).otherwise(F.array(F.lit("no reference")))
    found = S.booking_references(notes)
    return c.select("conv_id", "turn", F.array_join(found, ",").alias("refs"), S.reference_status(found).alias("status"))


@query("f20_date_points", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <= 2 THEN 25 WHEN o_orderkey % 10 <= 4 THEN 18 WHEN o_orderkey % 10 <= 7 THEN 10 ELSE 0 END AS card, CASE WHEN o_orderkey % 10 <= 2 THEN 5 WHEN o_orderkey % 10 <= 4 THEN 3 WHEN o_orderkey % 10 <= 7 THEN 1 ELSE 0 END AS booking FROM orders")
def f20(spark, d):
    days = F.datediff(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 10).cast("int")), F.col("o_orderdate").cast("date"))
    return read(spark, d, "orders").select("o_orderkey", S.date_points(days, F.lit(False)).alias("card"), S.date_points(days, F.lit(True)).alias("booking"))


@query("x2_postings", "SELECT token, p_partkey AS ref, count(*) AS hits FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS token FROM part) GROUP BY ALL")
def x2(spark, d):
    return X.postings(read(spark, d, "part"), "p_partkey", "p_name")


@query("x3_search", """WITH p AS (SELECT p_partkey AS ref, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS token FROM part), z AS (SELECT ref, count(*) AS size FROM p GROUP BY ref), s AS (SELECT count(*) AS docs, avg(size) AS mean FROM z),
    h AS (SELECT ref, asked, count(*) AS tf FROM p JOIN (VALUES ('re'), ('wid')) q(asked) ON starts_with(token, asked) GROUP BY ALL), f AS (SELECT asked, count(*) AS df FROM h GROUP BY asked)
    SELECT ref, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM h JOIN f USING (asked) JOIN z USING (ref), s GROUP BY ref HAVING count(*) = 2 ORDER BY score DESC, ref LIMIT 200""")
def x3(spark, d):
    return X.search(X.postings(read(spark, d, "part"), "p_partkey", "p_name"), "re wid", 200)
