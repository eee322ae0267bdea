"""Reconciliation tables derived from the given ones, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MINOR = "CAST(ROUND(o_totalprice * 100) AS BIGINT)"
SIGN = "(CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE 1 END)"
CURRENCY = "CASE WHEN o_custkey % 3 = 0 THEN 'EUR' ELSE 'CZK' END"
AMOUNT_TEXT = f"concat(CAST(CAST(FLOOR({MINOR} / 100) AS BIGINT) AS STRING), ',', lpad(CAST({MINOR} % 100 AS STRING), 2, '0'))"
RES = "CAST(FLOOR(o_orderkey / 2) AS BIGINT)"
REF = f"CASE WHEN {RES} % 5 <> 0 THEN concat('R', CAST({RES} AS STRING)) END"

TABLES = {
    "invoice": f"""SELECT concat('I', lpad(CAST(o_orderkey AS STRING), 10, '0')) AS invoice_id, o_orderkey AS code, o_custkey AS customer,
        {SIGN} * {MINOR} AS total_minor, {CURRENCY} AS currency, CAST(o_orderdate AS DATE) AS doc_date,
        CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) END AS paid_at, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END AS pay_method,
        CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE 1 END AS included, {REF} AS booking_reference, {RES} AS reservation_id,
        CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END AS linked, CASE WHEN o_orderkey % 7 <> 0 THEN concat('G', CAST({RES} AS STRING)) END AS internal_code FROM {{orders}}""",
    "booking": f"""SELECT concat('B', lpad(CAST(o_orderkey AS STRING), 10, '0')) AS source_id, CASE WHEN o_orderkey % 14 = 6 THEN concat('X', CAST(o_orderkey AS STRING)) WHEN o_orderkey % 10 <> 4 THEN {REF} END AS booking_reference,
        {SIGN} * CASE WHEN o_orderkey % 13 = 0 THEN {MINOR} + 1 WHEN o_orderkey % 11 = 0 THEN CAST(FLOOR({MINOR} / 2) AS BIGINT) ELSE {MINOR} END AS amount_minor,
        {CURRENCY} AS currency, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INT) AS paid_on, concat('P', CAST(o_custkey AS STRING)) AS payment_id,
        CASE WHEN o_orderkey % 23 = 0 THEN 'cancelled' ELSE 'ok' END AS status FROM {{orders}} WHERE o_orderkey % 2 = 0""",
    "payout": f"""SELECT CAST(FLOOR(o_orderkey / 2) AS BIGINT) AS n, concat('B', lpad(CAST(o_orderkey AS STRING), 10, '0')) AS source_id, CASE WHEN o_orderkey % 14 = 6 THEN concat('X', CAST(o_orderkey AS STRING)) WHEN o_orderkey % 10 <> 4 THEN {REF} END AS booking_reference,
        {SIGN} * {MINOR} AS amount_minor, concat('P', CAST(o_custkey AS STRING)) AS payment_id FROM {{orders}} WHERE o_orderkey % 2 = 0""",
    "card": f"""SELECT concat('C', lpad(CAST(o_orderkey AS STRING), 10, '0'), '-', CAST(n AS STRING)) AS source_id, {SIGN} * {MINOR} AS amount_minor,
        {CURRENCY} AS currency, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) AS paid_on, CAST(o_custkey % 7 AS BIGINT) AS terminal
        FROM {{orders}} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 AS n) twice WHERE o_orderkey % 2 = 1 AND (n = 0 OR o_orderkey % 19 = 0)""",
    "allocation": """SELECT concat('I', lpad(CAST(l_orderkey AS STRING), 10, '0')) AS invoice_id, concat('S', CAST(l_partkey AS STRING)) AS source_id,
        CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS amount_minor, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS active,
        CASE WHEN l_linestatus = 'F' THEN 'AUTO' ELSE 'MANUAL' END AS method, l_orderkey, l_linenumber, l_suppkey, CAST(l_shipdate AS DATE) AS made_on FROM {lineitem}""",
    "movement": """SELECT event_id AS movement_id, CASE event_type WHEN 'purchase' THEN 'CASHBOOK' WHEN 'view' THEN 'CARD' WHEN 'click' THEN 'BOOKING' ELSE 'OTHER' END AS kind,
        CAST(ROUND(value) AS BIGINT) * 100 AS amount_minor, CASE WHEN user_id % 3 = 0 THEN 'EUR' ELSE 'CZK' END AS currency, CAST(ts AS DATE) AS day, ts, user_id
        FROM {events} WHERE CAST(ROUND(value) AS BIGINT) <> 0""",
    "membership": """SELECT l_orderkey AS group_id, concat('S', CAST(l_partkey AS STRING)) AS member, CASE WHEN l_linenumber % 2 = 0 THEN 'DOCUMENT' ELSE 'SOURCE' END AS side,
        CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS amount_minor, CASE WHEN l_orderkey % 3 = 0 THEN 'EUR' ELSE 'CZK' END AS currency, CAST(l_shipdate AS DATE) AS made_on,
        CASE WHEN l_linestatus = 'F' THEN 'AUTO' ELSE 'MANUAL' END AS method FROM {lineitem}""",
    "bank_raw": f"""SELECT o_orderkey AS row_no, o_orderpriority AS file_id, CASE o_orderkey % 16 WHEN 0 THEN 'Uzávěrka' WHEN 1 THEN 'Počet transakcí: 5' WHEN 2 THEN '' WHEN 3 THEN 'VRÁCENÍ'
        WHEN 4 THEN 'Mystery' WHEN 5 THEN 'Dobropis' WHEN 6 THEN 'Info' ELSE ' Prodej  ' END AS kind_text, CASE WHEN o_orderkey % 16 = 2 OR o_orderkey % 37 = 0 THEN '' ELSE 'T1' END AS terminal,
        CASE WHEN o_orderkey % 16 = 2 THEN '' ELSE lpad(CAST(o_orderkey AS STRING), 8, '0') END AS seq, CASE WHEN o_orderkey % 16 = 2 THEN '' WHEN o_orderkey % 31 = 0 THEN '0,00' ELSE {AMOUNT_TEXT} END AS amount_text,
        CASE WHEN o_orderkey % 16 = 2 THEN '' WHEN o_custkey % 3 = 0 THEN 'eur' ELSE 'Kč' END AS currency_text, CASE WHEN o_orderkey % 3 = 0 THEN '1,50' ELSE '' END AS tip_text FROM {{orders}}""",
    "cash_raw": f"""SELECT o_orderkey AS row_no, CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE concat(CAST(o_orderkey AS STRING), '.0') END AS number, CASE WHEN o_orderkey % 16 = 0 THEN 'Počáteční stav' ELSE o_orderpriority END AS label,
        CASE WHEN o_orderkey % 5 = 0 THEN 'hotově' ELSE 'Karta' END AS form, CASE WHEN o_orderkey % 3 = 0 THEN {AMOUNT_TEXT} ELSE '' END AS income, CASE WHEN o_orderkey % 3 = 1 OR o_orderkey % 21 = 0 THEN {AMOUNT_TEXT} ELSE '' END AS expense,
        concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 12:30:00') AS issued FROM {{orders}}""",
    "alert": """SELECT event_id AS alert_id, concat('["', CAST(user_id AS STRING), '","', CAST(user_id + 1 AS STRING), '"]') AS group_ids FROM {events} WHERE event_type = 'error'""",
}
BASE = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or one of TABLES."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if f"{{{t}}}" in TABLES[name]}
    return spark.sql(TABLES[name], **used)


def ctes(*names: str) -> str:
    """WITH ... for DuckDB, without what follows."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n].format(**{t: t for t in BASE})})" for n in names)
