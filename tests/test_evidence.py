"""Matching evidence, references and the replay of documents against plain Python."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import matching as M
from ledgerloom.plans import registry

from .conftest import SF

DAY = dt.date(2026, 3, 1)


def test_scores(spark):
    """A payout's own reference decides, with none or the same on the document; others conflict."""
    cols = "invoice_id string, source_id string, remaining_minor long, amount_minor long, doc_reference string, source_reference string, linked int, internal_code string, is_booking int, doc_date date, paid_on date, paid_at date"
    cases = [("R1", "R1", 1, "G1", 1), ("R1", "R1", 0, None, 1), (None, "R1", 1, "G1", 1), ("R1", None, 1, "G1", 1), ("", "", 1, "G1", 1), ("R1", "R2", 1, "G1", 1), ("R1", None, 1, "G1", 0)]
    rows = [(f"I{k}", f"S{k}", 500, 500, *c, DAY, DAY + dt.timedelta(3), DAY) for k, c in enumerate(cases)]
    found = M.scored_pairs(spark.createDataFrame(rows, cols), F.col("is_booking") == 1)
    got = {r["invoice_id"]: (r["score"], r["conflicting"]) for r in found.collect()}
    assert [got[f"I{k}"] for k in range(7)] == [(98, 0), (63, 0), (98, 0), (18, 0), (18, 0), (18, 1), (83, 0)]
    auto = {r["invoice_id"]: r["can_auto"] for r in M.decided(found, F.col("is_booking") == 1).collect()}
    assert [auto[f"I{k}"] for k in range(7)] == [1, 0, 1, 0, 0, 0, 0]
    codes = {r["invoice_id"]: [e["code"] for e in r["evidence"]] for r in M.evidence(found, F.col("is_booking") == 1).collect()}
    assert codes["I0"] == ["EXACT_AMOUNT", "BOOKING_ID", "DIRECT_LINK", "INTERNAL_CODE", "DATE"] and codes["I5"] == ["EXACT_AMOUNT", "BOOKING_CONFLICT", "DATE"] and codes["I6"] == ["EXACT_AMOUNT", "DATE", "PAID_AT"]


def test_references(spark):
    texts = ["Original ID: 6689102875", "Channel reservation id 6689102875", "OriginalID=6689102875", "original id 12345", "x <b>Original&nbsp;</b>ID: 12345678901234567890123", "Original ID: 111111<br>Channel Reservation ID: 222222", "a<b>1", "a &lt;br/&gt; b &hellip; &#8364;\r\n\r\n\r\n\r\nc", "", "no note"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, x string").select("k", S.booking_references(F.array("x")).alias("refs"), S.normalize_channel(F.col("x")).alias("plain")).orderBy("k").collect()

    plain = [
        "Original ID: 6689102875", "Channel reservation id 6689102875", "OriginalID=6689102875", "original id 12345", "x Original\u00a0 ID: 12345678901234567890123",
        "Original ID: 111111\nChannel Reservation ID: 222222", "a<b>1", "a \n b … €\n\nc", "", "no note",
    ]
    assert [r["plain"] for r in got] == [p if p != "a<b>1" else "a 1" for p in plain]
    assert [r["refs"] for r in got] == [["6689102875"]] * 3 + [[], [], ["111111", "222222"], [], [], [], []]


def outcomes(docs, lines, cards, days=2):
    """docs (id, currency, ref, remaining, date, paid), lines (id, currency, ref, amount, day), cards (id, currency, amount, day)."""
    used, locked, out = {}, set(), {}
    for i, currency, ref, left, date, paid in sorted(docs, key=lambda r: (r[4], r[0])):
        own = [x for x in sorted(lines, key=lambda r: (r[4], r[0])) if ref is not None and x[1] == currency and x[2] == ref]
        hit = next((x[0] for x in own if x[3] - used.get(x[0], 0) >= abs(left)), None)
        if hit is None:
            near = [x for x in sorted(cards, key=lambda r: (r[3], r[0])) if x[1] == currency and abs((x[3] - (paid or date)).days) <= days]
            hit = next((x[0] for x in near if x[2] - used.get(x[0], 0) >= abs(left)), None)
        if hit is None:
            out[i] = ("BOOKING_SOURCE_ALREADY_USED" if own else "NONE", None)
        elif hit in locked or left < 0:
            out[i] = ("MATCH_FAILED", hit)
        else:
            used[hit] = used.get(hit, 0) + left
            locked.add(hit)
            out[i] = ("MATCHED", hit)
    return out


def test_match_documents(spark):
    rng = random.Random(4)
    day = lambda: DAY + dt.timedelta(rng.randrange(25))
    for _ in range(3):
        docs = [(f"I{k:03}", rng.choice(["CZK", "EUR"]), rng.choice([None, "R1", "R2", "R3"]), rng.choice([-100, 100, 150, 200]), day(), rng.choice([None, day()])) for k in range(60)]
        lines = [(f"B{k:02}", rng.choice(["CZK", "EUR"]), rng.choice([None, "R1", "R2", "R3"]), rng.choice([100, 150, 400]), day()) for k in range(12)]
        cards = [(f"C{k:02}", rng.choice(["CZK", "EUR"]), rng.choice([100, 150, 200, 350]), day()) for k in range(25)]
        found = M.match_documents(
            spark.createDataFrame(docs, "invoice_id string, currency string, booking_reference string, remaining_minor long, doc_date date, paid_at date"),
            spark.createDataFrame(lines, "source_id string, currency string, booking_reference string, amount_minor long, paid_on date"),
            spark.createDataFrame(cards, "source_id string, currency string, amount_minor long, paid_on date"),
        )
        assert {r["invoice_id"]: (r["outcome"], r["source_id"]) for r in found.collect()} == outcomes(docs, lines, cards)
        kinds = {r["code"]: r["severity"] for r in M.payment_alerts(found).collect()}
        assert kinds == {"MATCH_FAILED": "INFO", "BOOKING_SOURCE_ALREADY_USED": "CRITICAL"}


def test_cards_in_many_runs(spark, monkeypatch):
    """One currency with rows on every day, few different amounts, documents not in the order of their paydays: runs of 3
    days give what one pass gives, and a run is a group of its own."""
    rng = random.Random(6)
    monkeypatch.setattr(M, "RUN_DAYS", 3)
    days = [DAY + dt.timedelta(k) for k in range(90)]
    docs = [(f"I{k:03}", "CZK", None, rng.choice([100, 100, 150, -100]), d + dt.timedelta(rng.randrange(-9, 9)), d) for k, d in enumerate(days * 3)]
    cards = [(f"C{k:03}", "CZK", rng.choice([100, 150, 260]), d) for k, d in enumerate(days * 2)]
    found = M.match_documents(
        spark.createDataFrame(docs, "invoice_id string, currency string, booking_reference string, remaining_minor long, doc_date date, paid_at date"),
        spark.createDataFrame([], "source_id string, currency string, booking_reference string, amount_minor long, paid_on date"),
        spark.createDataFrame(cards, "source_id string, currency string, amount_minor long, paid_on date"),
    )
    want = outcomes(docs, [], cards)
    assert {r["invoice_id"]: (r["outcome"], r["source_id"]) for r in found.collect()} == want and len({w[0] for w in want.values()}) == 3


def test_match_documents_on_the_tables(spark):
    from ledgerloom.plans.adapters import read

    docs = M.active_invoices(read(spark, SF, "invoice"), registry.used(spark, SF)).select("invoice_id", "currency", "booking_reference", "remaining_minor", "doc_date", "paid_at").collect()
    lines = read(spark, SF, "booking").select("source_id", "currency", "booking_reference", "amount_minor", "paid_on").collect()
    cards = read(spark, SF, "card").select("source_id", "currency", "amount_minor", "paid_on").collect()
    want = outcomes(*[[tuple(r) for r in x] for x in (docs, lines, cards)])
    got = {r["invoice_id"]: (r["outcome"], r["source_id"]) for r in registry.QUERIES["m14_auto_match_documents"](spark, SF).collect()}
    assert got == want and registry.QUERIES["g12_payment_alerts"](spark, SF).count() == sum(o in ("MATCH_FAILED", "BOOKING_SOURCE_ALREADY_USED") for o, _ in want.values())


def test_first_with_enough():
    rng = random.Random(8)
    for n in (1, 2, 7, 33):
        plain = [rng.randrange(-3, 20) for _ in range(n)]
        left = M.Remaining(list(plain))
        for _ in range(300):
            i, v, begin, end, amount = rng.randrange(n), rng.randrange(-3, 20), rng.randrange(n + 1), rng.randrange(n + 1), rng.randrange(1, 22)
            plain[i] = v
            left.set(i, v)
            assert left.first(begin, end, amount) == next((k for k in range(begin, end) if plain[k] >= amount), None)


def test_many_cards_of_a_day(spark):
    """Each document takes the last card row that has enough: the day's rows are not gone through for each."""
    n, day = 30_000, dt.date(2026, 1, 5)
    ids = spark.range(1, n + 1)
    docs = ids.selectExpr("concat('d', lpad(id, 6, '0')) AS invoice_id", "'CZK' AS currency", f"{n + 1} - id AS remaining_minor").withColumn("doc_date", F.lit(day)).withColumn("payday", F.lit(day))
    cards = ids.selectExpr("concat('c', lpad(id, 6, '0')) AS source_id", "'CZK' AS currency", "id AS amount_minor").withColumn("paid_on", F.lit(day))
    began = time.monotonic()
    got = M.match_cards(docs, cards).where("outcome = 'MATCHED' AND int(substr(invoice_id, 2)) + int(substr(source_id, 2)) = 30001").count()
    assert got == n and time.monotonic() - began < 60
