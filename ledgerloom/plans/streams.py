"""Queries that run a store or a stream to its end over rows of the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.scratch import scratch
from ..operators.search import Index
from ..operators.store import Store
from ..sources import files
from ..streaming import ingest
from .adapters import read
from .registry import REPLAY_SQL, query

DAYS = [dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2), dt.datetime(2026, 1, 3)]
STORED = "o_orderkey long, o_orderstatus string, content string"


@query("t3_atomic_append", """SELECT o_orderkey, TIMESTAMP '2026-01-01' + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END * INTERVAL 1 DAY AS first_seen,
    TIMESTAMP '2026-01-01' + CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 THEN 2 ELSE 0 END * INTERVAL 1 DAY AS last_seen FROM orders""")
def t3(spark, d):
    """Three batches: two thirds of the orders; some of them with new ones but one other content, which is rejected; a
    quarter of them again with the last third."""
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus").withColumn("content", S.sha256_text(F.col("o_orderkey"), F.col("o_orderstatus")))
    store = Store(spark, scratch(spark, "store"), STORED, ("o_orderkey",), "content")
    other = o.agg(F.max(F.when(F.col("o_orderkey") % 3 == 1, F.col("o_orderkey"))).alias("o_orderkey")).select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit("X").alias("content"))
    for name, day, batch in (("first", DAYS[0], o.where("o_orderkey % 3 <> 0")), ("conflict", DAYS[1], o.where("o_orderkey % 2 = 0").join(other, "o_orderkey", "left_anti").unionByName(other)), ("second", DAYS[2], o.where("o_orderkey % 3 = 0 OR o_orderkey % 4 = 0"))):
        store.append(batch, name, day)
    return store.rows().select("o_orderkey", "first_seen", "last_seen")


@query("t10_stream_ingest", """WITH f AS (SELECT o_orderkey AS seq, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS amount_minor, o_orderkey % 6 AS file FROM orders UNION ALL SELECT o_orderkey, CAST(ROUND(o_totalprice * 100) AS BIGINT), (o_orderkey + 1) % 6 FROM orders WHERE o_orderkey % 10 = 0)
    SELECT DISTINCT seq, amount_minor FROM f WHERE file <> 4""")
def t10(spark, d):
    """Six files; a tenth of the orders are in two of them; in the fifth some identities come with two contents, so that it
    is rejected as a whole, whatever the order in which the files come."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.expr("CAST(ROUND(o_totalprice * 100) AS BIGINT)").alias("amount_minor"))
    files = o.withColumn("file", F.col("seq") % 6).unionByName(o.where("seq % 10 = 0").withColumn("file", (F.col("seq") + 1) % 6))
    files = files.unionByName(o.where("seq % 6 = 4").withColumn("amount_minor", F.col("amount_minor") + 1).withColumn("file", F.lit(4).cast("long")))
    drops, store = scratch(spark, "drops"), Store(spark, scratch(spark, "store"), "seq long, amount_minor long, content string", ("seq",), "content")
    files.repartition("file").write.partitionBy("file").parquet(drops)
    prepare = lambda df: df.select("seq", "amount_minor", S.sha256_text(F.col("seq"), F.col("amount_minor")).alias("content"))
    ingest.ingest_drops(spark, drops, "seq long, amount_minor long, file long", store, scratch(spark, "cp"), prepare, seen_at=DAYS[0])
    return store.rows().select("seq", "amount_minor")


@query("t11_stream_pair", REPLAY_SQL, "movement", recursive=True)
def t11(spark, d):
    """The movements as a stream that is run to its end: rows of a far day come last, so that the watermark passes all."""
    schema = "movement_id long, currency string, amount_minor long, ts timestamp, cash int"
    rows = read(spark, d, "movement").where("kind IN ('CASHBOOK', 'CARD', 'BOOKING')")
    rows = rows.select("movement_id", "currency", "amount_minor", F.col("ts").cast("timestamp").alias("ts"), (F.col("kind") == "CASHBOOK").cast("int").alias("cash"))
    drops, out, checkpoint = (scratch(spark, n) for n in ("drops", "out", "cp"))
    rows.write.parquet(drops)
    last = rows.agg(F.max("ts").alias("ts"))
    for k in range(3):
        if k:
            last.select(F.lit(-k).cast("long").alias("movement_id"), F.lit("END").alias("currency"), F.lit(k).cast("long").alias("amount_minor"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(0).alias("cash")).write.mode("append").parquet(drops)
        ingest.run_to_end(ingest.paired_once(ingest.read_drops(spark, drops, schema)), out, checkpoint)
    return spark.read.schema("movement_id long, outcome string, source_id long").parquet(out)


FILES = 4


def exported(spark, d, table, names: dict[str, str], key: str):
    """Writes the rows of a table as one CSV file for each of FILES, in the file format's columns (names: header to
    expression; other headers are empty), and returns the files' paths. Every seventh text has a quoted line break."""
    headers = names["headers"]
    cols = [F.expr(names.get(h, "''")).cast("string").alias(h) for h in headers]
    rows = read(spark, d, table).withColumn("part", F.pmod(F.col(key), F.lit(FILES))).repartition("part").sortWithinPartitions("part", key)
    folder = scratch(spark, "export")
    rows.select("part", *cols).write.partitionBy("part").csv(folder, header=True, escape='"')
    return [f"{folder}/part={k}" for k in range(FILES)]


def imported(spark, reader, paths, shown: dict[str, str]):
    found = [reader(spark, p).select(F.lit(k).alias("part"), "row_number", *[F.col(f"`{h}`").alias(n) for n, h in shown.items()]) for k, p in enumerate(paths)]
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    return rows


NUMBERED = "CAST({key} % 4 AS INTEGER) AS part, row_number() OVER (PARTITION BY {key} % 4 ORDER BY {key}) AS row_number"


@query("s1_read_bank_files", f"SELECT * FROM (SELECT {NUMBERED.format(key='row_no')}, nullif(trim(kind_text), '') AS kind, nullif(terminal, '') AS terminal, nullif(seq, '') AS seq, nullif(amount_text, '') AS amount, concat('Place ', CAST(row_no % 7 AS STRING), CASE WHEN row_no % 7 = 0 THEN chr(10) ELSE ' ' END, '\"x\"') AS place FROM bank_raw)", "bank_raw")
def s1(spark, d):
    names = {"headers": files.BANK_HEADERS, "Typ transakce": "kind_text", "ID Terminálu": "terminal", "SEQ ID": "seq", "Částka": "amount_text", "Obchodní místo": "concat('Place ', CAST(row_no % 7 AS STRING), CASE WHEN row_no % 7 = 0 THEN chr(10) ELSE ' ' END, '\"x\"')"}
    return imported(spark, files.read_bank_csv, exported(spark, d, "bank_raw", names, "row_no"), {"kind": "Typ transakce", "terminal": "ID Terminálu", "seq": "SEQ ID", "amount": "Částka", "place": "Obchodní místo"})


@query("s2_read_payout_files", f"SELECT {NUMBERED.format(key='n')}, booking_reference AS reference, CAST(amount_minor AS STRING) AS amount, payment_id FROM payout", "payout")
def s2(spark, d):
    names = {"headers": files.BOOKING_HEADERS, "Číslo rezervace": "booking_reference", "Částka": "amount_minor", "ID platby": "payment_id"}
    return imported(spark, files.read_booking_csv, exported(spark, d, "payout", names, "n"), {"reference": "Číslo rezervace", "amount": "Částka", "payment_id": "ID platby"})


@query("s3_read_cashbook_files", f"SELECT {NUMBERED.format(key='row_no')}, issued, nullif(number, '') AS number, nullif(income, '') AS income, nullif(expense, '') AS expense FROM cash_raw", "cash_raw")
def s3(spark, d):
    names = {"headers": files.CASHBOOK_HEADERS, "Vystaveno": "issued", "Číslo": "number", "Označení": "label", "Forma úhrady": "form", "Příjem": "income", "Výdaj": "expense"}
    return imported(spark, files.read_cashbook_csv, exported(spark, d, "cash_raw", names, "row_no"), {"issued": "Vystaveno", "number": "Číslo", "income": "Příjem", "expense": "Výdaj"})


@query("x3_indexed_search", """WITH n AS (SELECT CAST(p_partkey AS STRING) AS ref, CASE WHEN p_partkey % 10 = 0 THEN concat(p_name, ' Red Widget red') ELSE p_name END AS name FROM part WHERE p_partkey % 11 <> 5),
    p AS (SELECT ref, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS token FROM n), z AS (SELECT ref, count(*) AS size FROM p GROUP BY ref), s AS (SELECT count(*) AS docs, avg(size) AS mean FROM z),
    h AS (SELECT ref, asked, count(*) AS tf FROM p JOIN (VALUES ('re'), ('wid')) q(asked) ON starts_with(token, asked) GROUP BY ALL), f AS (SELECT asked, count(*) AS df FROM h GROUP BY asked)
    SELECT ref, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM h JOIN f USING (asked) JOIN z USING (ref), s GROUP BY ref HAVING count(*) = 2 ORDER BY score DESC, ref LIMIT 200""")
def x3_index(spark, d):
    """A search in an index at rest after some objects have changed and some have gone."""
    part = read(spark, d, "part").select("p_partkey", "p_name")
    index = Index(spark, scratch(spark, "index")).updated(part, "p_partkey", "p_name")
    changed = part.where("p_partkey % 10 = 0 AND p_partkey % 11 <> 5").withColumn("p_name", F.concat("p_name", F.lit(" Red Widget red")))
    return index.updated(changed, "p_partkey", "p_name", part.where("p_partkey % 11 = 5").select("p_partkey")).search("re wid", 200)


@query("s10_export_selected", """SELECT CAST(p_partkey AS STRING) AS p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('''-', p_name, chr(10), '"q"') ELSE p_name END AS name FROM part WHERE p_name LIKE '%re%'""")
def s10_selected(spark, d):
    """The objects that a search has found, exported and read again; the selection names each twice."""
    part = read(spark, d, "part")
    cells = part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-"), "p_name", F.lit('\n"q"'))).otherwise(F.col("p_name")).alias("name"))
    found, folder = part.where("p_name LIKE '%re%'").select("p_partkey"), scratch(spark, "export")
    files.export_csv(cells, folder, found.union(found), "p_partkey")
    return spark.read.csv(folder, schema="p_partkey string, name string", header=True, multiLine=True, escape='"')
