"""The store with its ledger, the file drops and the pairing stream."""

import datetime as dt
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import matching as M
from ledgerloom.operators import store as S
from ledgerloom.streaming import ingest

SCHEMA = "terminal string, seq long, amount long, content string"
T0 = dt.datetime(2026, 1, 1)


def rows(spark, *given):
    return spark.createDataFrame([(t, s, a, f"{a}") for t, s, a in given], SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return S.Store(spark, "file://" + str(tmp_path / "store"), SCHEMA, ("terminal", "seq"), "content")


def held(store):
    return sorted((r["terminal"], r["seq"], r["amount"], r["first_seen"], r["last_seen"]) for r in store.rows().collect())


def test_append(spark, store):
    later = T0 + dt.timedelta(days=1)
    got = store.append(rows(spark, ("a", 1, 5), ("a", 1, 5), ("b", 1, 7)), "one", T0)
    assert (got["outcome"], got["rows"], got["added"], got["identical"]) == ("LOADED", 3, 2, 1)
    assert store.append(rows(spark, ("a", 1, 5), ("c", 1, 1)), "two", later)["added"] == 1
    assert held(store) == [("a", 1, 5, T0, later), ("b", 1, 7, T0, T0), ("c", 1, 1, later, later)]
    # One conflict with the store, or within the batch, rejects all of it.
    for name, batch in (("three", [("a", 1, 6), ("d", 1, 1)]), ("four", [("e", 1, 1), ("e", 1, 2)])):
        assert (got := store.append(rows(spark, *batch), name, later))["outcome"] == "REJECTED" and got["added"] == 0
    assert len(held(store)) == 3 and store.ledger().count() == 4
    # A published batch writes nothing again, whatever it holds.
    assert store.append(rows(spark, ("z", 1, 1)), "two", later)["added"] == 1 and len(held(store)) == 3
    assert store.append(rows(spark), "empty", later)["rows"] == 0
    with pytest.raises(ValueError):
        store.append(rows(spark, (None, 1, 1)), "bad", later)


def test_a_crash_before_publishing(spark, store, monkeypatch):
    store.append(rows(spark, ("a", 1, 5)), "one", T0)
    real = S._publish

    def crash(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(S, "_publish", crash)
    with pytest.raises(KeyboardInterrupt):
        store.append(rows(spark, ("b", 1, 5)), "two", T0)
    assert [r[0] for r in held(store)] == ["a"]
    monkeypatch.setattr(S, "_publish", real)
    store.append(rows(spark, ("b", 1, 5)), "two", T0)
    assert [r[0] for r in held(store)] == ["a", "b"]


def test_two_writers(spark, store):
    """Both hold one same row and one conflicting identity: one batch is loaded first, the other sees it."""
    outcomes = {}

    def write(name, amount):
        outcomes[name] = store.append(rows(spark, ("same", 1, 5), (name, 1, 1), *([("x", 1, amount)] if amount else [])), name, T0)

    threads = [threading.Thread(target=write, args=(f"w{i}", a)) for i, a in enumerate([1, 2, 0, 0])]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(outcomes[n]["outcome"] for n in ("w0", "w1")) == ["LOADED", "REJECTED"]
    assert sum(o["added"] for o in outcomes.values()) == len(held(store)) == 5
    assert sorted(r["seq"] for r in store.ledger().collect()) == [1, 2, 3, 4]


def test_drops(spark, store, tmp_path):
    """Files one by one, again, in conflict, and after a crash: the same table as all at once."""
    folder, schema = str(tmp_path / "in"), "terminal string, seq long, amount long"
    prepare = lambda df: df.withColumn("content", F.col("amount").cast("string"))
    run = lambda: ingest.ingest_drops(spark, folder, schema, store, str(tmp_path / "cp"), prepare, seen_at=T0)

    def drop(*given):
        spark.createDataFrame(list(given), schema).coalesce(1).write.mode("append").parquet(folder)

    drop(("a", 1, 5), ("b", 1, 7))
    run()
    drop(("a", 1, 5), ("c", 1, 1))
    run()
    drop(("a", 1, 99), ("d", 1, 1))  # rejected as a whole
    run()
    drop(("a", 1, 5), ("b", 1, 7))  # the first file's rows under another name
    real = store.__class__.append

    def crash(self, *given):
        real(self, *given)
        raise RuntimeError("after publishing, before the stream's commit")

    store.__class__.append = crash
    try:
        with pytest.raises(Exception, match="after publishing"):
            run()
    finally:
        store.__class__.append = real
    run()
    run()
    assert [r[:3] for r in held(store)] == [("a", 1, 5), ("b", 1, 7), ("c", 1, 1)]
    assert [(r["outcome"], r["rows"], r["added"]) for r in store.ledger().orderBy("seq").collect()] == [("LOADED", 2, 2), ("LOADED", 2, 1), ("REJECTED", 2, 0), ("LOADED", 2, 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_pairing_in_any_order(spark, tmp_path, seed):
    """Rows shuffled within the lateness, in many files: as the batch replay of the same rows."""
    rng = random.Random(seed)
    made = [(i, rng.choice(["CZK", "EUR"]), rng.choice([100, 200, 300]), T0 + dt.timedelta(hours=rng.randrange(24 * 60)), int(rng.random() < 0.4)) for i in range(300)]
    schema = "movement_id long, currency string, amount_minor long, ts timestamp, cash int"
    arrival = sorted(made, key=lambda r: r[3] + dt.timedelta(hours=rng.random() * 40))
    ends = [(-1 - k, "END", k, T0 + dt.timedelta(days=100), 0) for k in range(2)]
    folder = tmp_path / "in"
    for k, part in enumerate([arrival[i : i + 40] for i in range(0, 300, 40)] + [[e] for e in ends]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = ingest.paired_once(ingest.read_drops(spark, str(folder), schema, maxFilesPerTrigger=1))
    ingest.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    d = spark.createDataFrame(made, schema).withColumn("day", F.to_date("ts"))
    want = sorted(tuple(r) for r in M.reconcile_cashbook(d.where("cash = 1"), d.where("cash = 0")).collect())
    assert got == want and {r[1] for r in want} == {"MATCHED", "SEVERAL", "NONE"}


def test_hot_key_by_days():
    """A key of many rows: a cash row looks at the days of its window, not at all free sources."""
    held, n = ingest.Waiting(None), 40_000
    for i in range(n):
        held.add(i * 6 * ingest.DAY, i)
        held.cash.append((i * 6 * ingest.DAY, n + i))
    again = ingest.Waiting(held.text())
    began = time.process_time()
    assert again.decide(n * 6 * ingest.DAY + 60 * ingest.DAY, 2) == [(n + i, "MATCHED", i) for i in range(n)]
    assert time.process_time() - began < 20 and again.next(2) is None
