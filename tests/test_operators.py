"""Operators on small cases of their own."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import groups as G
from ledgerloom.operators import matching as M
from ledgerloom.operators import state as T
from ledgerloom.plans import adapters, registry
from ledgerloom.sources import files

from .conftest import SF


def values(spark, text, f):
    return spark.createDataFrame([(x,) for x in text], "x string").select(f(F.col("x"))).toPandas().iloc[:, 0].tolist()


def test_money(spark):
    texts = ["1 234,565 CZK", "1 234,565", "(10,00)", "5210.70", "1.234,56 €", "1,234.56", "x"]
    minor = values(spark, texts, lambda x: S.to_minor(S.parse_decimal(x)))
    assert [None if m != m else int(m) for m in minor] == [123457, 123457, -1000, 521070, 123456, 123456, None]
    row = spark.range(1).select(S.format_money(F.lit(-12345), F.lit("CZK")), S.format_money(F.lit(191695), F.lit("EUR"))).first()
    assert tuple(row) == ("-123,45\u00a0Kč", "1\u00a0916,95\u00a0€")
    assert values(spark, ["Kč", " eur ", "USD"], S.normalize_currency) == ["CZK", "EUR", None]


def test_dates(spark):
    days = values(spark, ["30. července 2026", "30.07.2026", "5. 1. 2026", "2026-01-05", "31/12/2025", "32.1.2026", ""], S.parse_czech_date)
    assert days == [dt.date(2026, 7, 30), dt.date(2026, 7, 30), dt.date(2026, 1, 5), dt.date(2026, 1, 5), dt.date(2025, 12, 31), None, None]


def test_redaction(spark):
    assert values(spark, ["4111111111111111 a.b@c.cz"], S.redact) == ["411111******1111 ***@***"]


def test_waterfall(spark):
    docs = spark.createDataFrame([(1, "i1", 10000), (1, "i2", 5000)], "k int, doc string, amount long")
    src = spark.createDataFrame([(1, "c1", 8000), (1, "c2", 7000)], "k int, src string, amount long")
    assert sorted(tuple(r)[1:] for r in M.waterfall(docs, src, ["k"]).collect()) == [("i1", "c1", 8000), ("i1", "c2", 2000), ("i2", "c2", 5000)]


def replayed(cash, src, days):
    free, out = {s[0]: s for s in src}, []
    for c in sorted(cash, key=lambda r: (r[4], r[0])):
        hit = [s for s in free.values() if s[1:3] == c[1:3] and abs((s[3] - c[3]).days) <= days]
        if len(hit) == 1:
            del free[hit[0][0]]
        out.append((c[0], "MATCHED" if len(hit) == 1 else "NONE" if not hit else "SEVERAL", hit[0][0] if len(hit) == 1 else None))
    return sorted(out)


def test_cashbook_replay(spark):
    rng = random.Random(5)
    rows = [(i, "CZK", rng.choice([100, 200]), dt.date(2026, 1, 1) + dt.timedelta(rng.randrange(40)), None) for i in range(80)]
    rows = [(*r[:4], dt.datetime.combine(r[3], dt.time(rng.randrange(24)))) for r in rows]
    cols = "movement_id long, currency string, amount_minor long, day date, ts timestamp"
    got = M.reconcile_cashbook(spark.createDataFrame(rows[:40], cols), spark.createDataFrame(rows[40:], cols))
    assert sorted(tuple(r) for r in got.collect()) == replayed(rows[:40], rows[40:], 2)


def test_cashbook_replay_on_the_tables(spark):
    m = adapters.read(spark, SF, "movement").select("kind", "movement_id", "currency", "amount_minor", "day", "ts").collect()
    cash, src = ([tuple(r)[1:] for r in m if r["kind"] in k] for k in (["CASHBOOK"], ["CARD", "BOOKING"]))
    assert sorted(tuple(r) for r in registry.QUERIES["m13_auto_reconcile_cashbook"](spark, SF).collect()) == replayed(cash, src, 2)


def test_tree(spark):
    own = spark.createDataFrame([(1, 4000), (2, 1000), (3, -10000)], "group_id long, difference_minor long")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "parent long, child long")
    assert sorted(tuple(r) for r in G.tree_rollup(edges, own).collect()) == [(1, -5000, 3), (2, -9000, 2), (3, -10000, 1)]


def test_a_long_chain(spark, monkeypatch):
    """10,000 groups above each other in about 14 rounds; a second parent and cycles are told."""
    n = 10_000
    own = spark.range(n).select(F.col("id").alias("group_id"), F.lit(1).cast("long").alias("difference_minor"))
    edges = spark.range(1, n).select((F.col("id") - 1).alias("parent"), F.col("id").alias("child"))
    rounds, real = [], G._doubled
    monkeypatch.setattr(G, "_doubled", lambda s: rounds.append(1) or real(s))
    assert G.tree_rollup(edges, own).where("difference_minor <> 10000 - root OR groups <> 10000 - root").count() == 0 and len(rounds) <= 15
    few = edges.where("child < 9")
    assert {tuple(r) for r in G.tree_closure(few, own.where("group_id < 9")).collect()} == {(a, b) for b in range(9) for a in range(b + 1)}
    second = few.union(spark.createDataFrame([(5, 2)], "parent long, child long"))
    with pytest.raises(ValueError):
        G.tree_rollup(second, own)
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (7, 8)], "parent long, child long")
    with pytest.raises(ValueError):
        G.tree_rollup(loop, own)
    kinds = spark.createDataFrame([(7, "CZK"), (8, "EUR"), (4, "CZK"), (5, "CZK")], "group_id long, currency string")
    assert {tuple(r) for r in G.tree_violations(loop, kinds).collect()} == {("CYCLE", "1"), ("CYCLE", "2"), ("CYCLE", "3"), ("CURRENCY", "8")}
    assert [tuple(r) for r in G.tree_violations(second).where("rule = 'PARENTS'").collect()] == [("PARENTS", "2")]


def test_a_bucketed_store(spark):
    """A batch is compared with a bucketed store without an exchange on the store's side, also after it has grown."""
    import uuid

    name = f"store_{uuid.uuid4().hex}"
    old = spark.range(1000).select(F.col("id").alias("k"), F.lit("1").alias("h"))
    batch = spark.range(900, 1100).select(F.col("id").alias("k"), F.when(F.col("id") == 950, "2").otherwise("1").alias("h"))
    try:
        store = T.keep_bucketed(old, ["k"], name, 4)
        found = T.classify_new(batch.hint("merge"), store.hint("merge"), "k", "h")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert {r[0]: r[1] for r in found.groupBy("outcome").count().collect()} == {"NEW": 100, "IDENTICAL": 99, "CONFLICT": 1}
        T.grow_bucketed(found.where("outcome = 'NEW'").select("k", "h"), ["k"], name, 4)
        again = T.classify_new(batch.hint("merge"), spark.table(name).hint("merge"), "k", "h")
        assert again._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert {r[0]: r[1] for r in again.groupBy("outcome").count().collect()} == {"IDENTICAL": 199, "CONFLICT": 1}
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_files(spark, tmp_path):
    names = files.CASHBOOK_HEADERS
    path = tmp_path / "cash.csv"
    line = ["2026-07-30 12:00", "příjem", "007", "x", 'a "b", c', "50,00", "", "1", "EUR", "karta", "1", "12", "z"]
    quoted = ",".join('"' + x.replace('"', '""') + '"' for x in line)
    path.write_text("﻿report\n" + ",".join(n.upper() for n in names) + "\n" + quoted + "\n,,,,,,,,,,,,\n", encoding="utf-8")
    rows = files.read_cashbook_csv(spark, str(path)).collect()
    assert len(rows) == 1 and rows[0]["Číslo"] == "007" and rows[0]["Klient"] == 'a "b", c'
    files.export_csv(spark.createDataFrame([("=1+1", 2)], "a string, b int"), str(tmp_path / "out"))
    assert "'=1+1" in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    with pytest.raises(ValueError):
        files.read_bank_csv(spark, str(path))


def test_streams(spark, tmp_path):
    from ledgerloom.streaming import ingest

    schema = "id string, h string, ts timestamp"
    rows = [("a", "1", dt.datetime(2026, 1, 1)), ("a", "1", dt.datetime(2026, 1, 1, 5)), ("b", "1", dt.datetime(2026, 1, 2))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    ingest.run_to_end(ingest.deduplicated(ingest.read_drops(spark, str(tmp_path / "in"), schema), "ts", ["id", "h"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    for side in ("cash", "source"):
        spark.createDataFrame([(1, "CZK", 100, dt.datetime(2026, 1, 1 if side == "cash" else 2))], f"{side}_id long, {side}_currency string, {side}_minor long, {side}_ts timestamp").write.parquet(str(tmp_path / side))
    streams = [ingest.read_drops(spark, str(tmp_path / s), f"{s}_id long, {s}_currency string, {s}_minor long, {s}_ts timestamp") for s in ("cash", "source")]
    ingest.run_to_end(ingest.paired(*streams), str(tmp_path / "pairs"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 1
