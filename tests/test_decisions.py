"""Combinations against brute force, and small cases of imports and decisions."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import combinations as C
from ledgerloom.operators import decisions as D
from ledgerloom.operators import normalise as N
from ledgerloom.plans import decisions as plans
from ledgerloom.sources import payloads as P

from .conftest import SF

ITEMS = "block string, side string, id string, amount_minor long"


def brute(rows, tolerance):
    out = set()
    for block in {r[0] for r in rows}:
        docs, srcs = ([r for r in sorted(rows) if r[0] == block and r[1] == s] for s in ("DOCUMENT", "SOURCE"))
        for n, m in itertools.product(range(1, 7), range(1, 7)):
            if n + m <= 7:
                for a, b in itertools.product(itertools.combinations(docs, n), itertools.combinations(srcs, m)):
                    diff = sum(x[3] for x in a) - sum(x[3] for x in b)
                    if abs(diff) <= tolerance and len({x[3] > 0 for x in a + b}) == 1:
                        out.add((block, ",".join(x[2] for x in a), ",".join(x[2] for x in b), diff, 0))
    return out


def test_combinations(spark):
    rng = random.Random(3)
    rows = [(f"b{i % 4}", rng.choice(["DOCUMENT", "SOURCE"]), f"{i:03d}", rng.choice([1, 2, 3, 5, -4])) for i in range(32)]
    hot = [("hot", "SOURCE", f"h{i:03d}", 1) for i in range(40)] + [("hot", "DOCUMENT", "h", 1)]
    got = [tuple(r) for r in plans.joined(C.exact_combinations(spark.createDataFrame(rows + hot, ITEMS), 1)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 1) | {("hot", None, None, None, 1)}
    assert C.exact_combinations(spark.createDataFrame([], ITEMS), 1).count() == 0


def test_combinations_on_the_tables(spark):
    rows = [tuple(r) for r in plans.blocks(spark, SF).collect()]
    want = brute(rows, 1)
    assert {tuple(r) for r in plans.m2(spark, SF).collect()} == want
    exact = [w for w in want if w[3] == 0 and "," not in w[1]]
    one = {(w[1], w[2]) for w in exact if sum(x[1] == w[1] for x in exact) == 1}
    assert one and {tuple(r) for r in plans.m16(spark, SF).collect()} == one


def best_plain(anchors, others, days, limit):
    out = []
    for a in anchors:
        found = []
        for o in others:
            doc, src = (a, o) if a[0] == "INVOICE" else (o, a)
            if a[2] != o[2] or a[3] * o[3] <= 0:
                continue
            gap = None if a[4] is None or o[4] is None else abs((a[4] - o[4]).days)
            if days is not None and gap is not None and gap > days:
                continue
            band = next((k for k, most in enumerate((2, 4, 7)) if gap is not None and gap <= most), 3)
            if src[0] == "BOOKING":
                score = 75 * bool(src[5] and src[5] == doc[5]) + 15 * (a[3] == o[3]) + (5, 3, 1, 0)[band]
            else:
                score = 60 * (a[3] == o[3]) + (25, 18, 10, 0)[band] + 5 * (src[0] == "CARD" and doc[6])
            found.append((-min(100, score), abs(a[3] - o[3]), 10**9 if gap is None else gap, o[0], o[1]))
        out += [(a[1], n + 1, x[3], x[4], -x[0], x[1]) for n, x in enumerate(sorted(found)[:limit])]
    return sorted(out)


@pytest.mark.parametrize("days, limit", [(7, 5), (30, 3), (None, 4)])
def test_counterparts(spark, monkeypatch, days, limit):
    """Both directions, unknown days, many ties, one hot day; with parts of few rows."""
    from ledgerloom.operators import counterparts as P

    rng, base = random.Random(9), dt.date(2026, 5, 1)
    day = lambda: rng.choice([None] + [base + dt.timedelta(rng.choice([0, 0, 0, 3, 9, 20, 45]))] * 9)
    cols = "kind string, id string, currency string, amount_minor long, day date, reference string, paid boolean"
    docs = [("INVOICE", f"i{k:02d}", rng.choice(["CZK", "EUR"]), rng.choice([100, 100, 250, -100, 0]), day(), rng.choice([None, "", "R1", "R2"]), rng.random() < 0.5) for k in range(60)]
    src = [(rng.choice(["BOOKING", "CARD", "MANUAL"]), f"s{k:02d}", rng.choice(["CZK", "EUR"]), rng.choice([100, 101, 250, -100]), day(), rng.choice([None, "", "R1", "R2"]), False) for k in range(70)]
    for name in ("ANCHORS", "OTHERS"):
        monkeypatch.setattr(P, name, 7)
    a, b = spark.createDataFrame(docs, cols), spark.createDataFrame(src, cols)
    for x, y, p, q in ((a, b, docs, src), (b, a, src, docs)):
        assert sorted(tuple(r)[:6] for r in P.counterparts(x, y, days, limit).collect()) == best_plain(p, q, days, limit)


def test_preview_order(spark):
    rows = [(1, "DOCUMENT", "CZK", 10, 0), (1, "SOURCE", "EUR", 0, 0), (2, "DOCUMENT", "CZK", 0, 0), (2, "SOURCE", "CZK", 5, 0), (3, "DOCUMENT", "CZK", -9, 0), (3, "SOURCE", "CZK", -4, 0), (4, "DOCUMENT", "CZK", 9, 0), (4, "SOURCE", "CZK", -4, 0), (5, "SOURCE", "CZK", 4, 0), (6, "DOCUMENT", "CZK", 4, 1), (6, "SOURCE", "CZK", 4, 0)]
    got = D.preview(spark.createDataFrame(rows, "group_id int, side string, currency string, remaining_minor long, locked int"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "CURRENCY", 0), (2, "DOCUMENT_USED", 0), (3, "PARTIAL", -4), (4, "SIGN", 0), (5, "EMPTY_SIDE", 0), (6, "LOCKED", 0)]


def test_cashbook_times(spark):
    cols = "number string, label string, form string, income string, expense string, issued string"
    rows = [("7.0", "x", "karta", "50,00", "", "2026-07-30 00:30:00"), ("8", "x", "Karta", "", "1,00", "2026-01-30 00:30:00"), (None, None, None, None, None, None)]
    got = N.normalize_cashbook(spark.createDataFrame(rows, cols)).select("identity", "reason", "amount_minor", "direction", F.col("occurred_at").cast("string"))
    assert [tuple(r) for r in got.collect()] == [("7", None, 5000, "INCOME", "2026-07-29 22:30:00"), ("8", None, -100, "EXPENSE", "2026-01-29 23:30:00"), (None, "BLANK", None, None, None)]


def test_payload_shapes(spark):
    rows = [(1, '{"items":{"id":"a","total":"1.5"}}'), (2, '{"invoice_items":[{"id":"b","signed_amount":"-2"},{"id":""}],"items":[{"id":"c"}]}'), (3, "{}"), (4, None), (5, "not json")]
    got = P.explode_items(spark.createDataFrame(rows, "invoice int, payload string"), "invoice")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 150), (2, "b", -200)]
    bad = P.parse_reservations(spark.createDataFrame([("{}",), (None,)], "payload string")).collect()
    assert [list(r["channels"]) for r in bad] == [[], []]


def test_mentions(spark):
    rows = [("Original ID: 1234567 x Original ID: 7654321",), ("none",), ("",), (None,)]
    got = S.reference_mentions(spark.createDataFrame(rows, "note string"), "note").collect()
    assert [(r["note"][r["start_at"]:r["end_at"]], r["candidate"]) for r in got] == [("1234567", "1234567"), ("7654321", "7654321")]


def test_alert_fields(spark):
    day = dt.date(2026, 1, 1)
    old = spark.createDataFrame([(1, "a", day), (2, None, day), (3, "c", day)], "id int, x string, y date")
    new = spark.createDataFrame([(1, "b", day), (2, None, day), (3, "d", None)], "id int, x string, y date")
    members = spark.createDataFrame([(1, 9), (1, 8), (2, 7)], "id int, group_id int")
    assert [(r[0], list(r[1]), list(r[2])) for r in D.revision_alerts(old, new, members, "id", ["x", "y"]).collect()] == [(1, ["x"], [8, 9])]


def test_unique_subset_of_any_size(spark):
    rng = random.Random(4)
    rows = [("two ways", f"t{i}", a) for i, a in enumerate([60, 40, 20, 20, 20, 15, 10, 10, 5])] + [("seven", f"s{i}", 2**i) for i in range(8)] + [("fifteen", f"f{i:02d}", 2**i) for i in range(15)]
    rows += [("credit", "c1", 100), ("credit", "c2", -30), ("hot", "h", 7)] + [("hot", f"h{i:03d}", 1) for i in range(D.MOST_LINES)]
    rows += [("random", f"r{i}", rng.choice([1, 2, 3, 50, -4])) for i in range(9)]
    targets = [("two ways", "T", 100), ("seven", "S", 127), ("fifteen", "F", 2**15 - 1), ("fifteen", "G", 5), ("fifteen", "N", 2**15), ("credit", "C", 70), ("hot", "H", 7)] + [("random", f"R{t}", t) for t in range(-9, 70)]
    got = {tuple(r) for r in D.unique_exact_subset(spark.createDataFrame(rows, "block string, id string, amount_minor long"), spark.createDataFrame(targets, "block string, target_id string, target_minor long")).collect()}
    want = {("H", None, 1)}
    for block, target, minor in targets:
        lines = [r for r in sorted(rows) if r[0] == block]
        sets = [c for n in range(1, len(lines) + 1) for c in itertools.combinations(lines, n) if sum(x[2] for x in c) == minor] if block != "hot" else []
        want |= {(target, ",".join(x[1] for x in sets[0]), 0)} if len(sets) == 1 else set()
    assert got == want and {("S", "s0,s1,s2,s3,s4,s5,s6", 0), ("C", "c1,c2", 0)} < got and not any(r[0] == "T" for r in got)


def test_all_combinations(spark):
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(n)
    rows = [
        ("CZK", "R1", "DOCUMENT", "d1", 100, day(0)), ("CZK", "R1", "DOCUMENT", "d2", -20, day(0)), ("CZK", "R1", "SOURCE", "s1", 80, day(3)),  # a credit note, a net payment
        ("CZK", None, "DOCUMENT", "d3", 500, day(100)), ("CZK", None, "SOURCE", "c1", 200, day(101)), ("CZK", None, "SOURCE", "c2", 300, day(106)),  # card sources
        ("CZK", None, "DOCUMENT", "d4", 500, day(200)), ("EUR", None, "SOURCE", "c3", 500, day(200)),
        ("CZK", "R2", "DOCUMENT", "d5", 70, day(300)), ("CZK", "R2", "SOURCE", "s2", 70, day(308)),  # beyond the window
    ] + [("USD", None, "DOCUMENT", "u", 1, day(0))] + [("USD", None, "SOURCE", f"u{i:02d}", 1, day(i)) for i in range(27)]
    got = plans.all_combinations(spark.createDataFrame(rows, "currency string, booking_reference string, side string, id string, amount_minor long, day date"), 1, 7)
    assert {tuple(r) for r in got.collect()} == {("CZK|2026-01-01", "d1,d2", "s1", 0, 0), ("CZK|2026-04-11", "d3", "c1,c2", 0, 0), ("USD|2026-01-01", None, None, None, 1)}


def test_m2_reports_the_islands(spark):
    got = [tuple(r) for r in plans.m2_all(spark, SF).collect()]
    assert got and any(r[4] == 1 for r in got) and len(got) == len(set(got))
