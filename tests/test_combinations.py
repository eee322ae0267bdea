"""Combinations over member sets against a plain search, its scores and decisions."""

import datetime as dt
import hashlib
import itertools
import json
import random

import pytest

from ledgerloom.operators import combinations as C

ITEMS = "block string, currency string, side string, id string, version long, remaining long, day date, reference string, linked int, internal_code string, paid_at date, is_booking int"
DAY = dt.date(2026, 7, 1)


def item(block, side, ident, amount, day=0, ref=None, linked=0, code=None, paid=False, booking=0, currency="CZK"):
    when = DAY + dt.timedelta(day)
    return (block, currency, side, ident, 1, amount, when, ref, linked, code, when if paid else None, booking)


def generated(seed, blocks=6):
    rng, out = random.Random(seed), []
    for b in range(blocks):
        for k in range(rng.randrange(1, 6)):
            out.append(item(f"b{b}", "DOCUMENT", f"d{b}.{k}", rng.choice([100, 200, 300, -100]), rng.randrange(12), rng.choice([None, "", f"R{b}", f"Q{b}"]), rng.randrange(2), rng.choice([None, "G1", "G2"]), rng.random() < 0.6))
        for k in range(rng.randrange(1, 6)):
            book = rng.randrange(2)
            out.append(item(f"b{b}", "SOURCE", f"s{b}.{k}", rng.choice([100, 200, 301, 500, -100]), rng.randrange(12), rng.choice([None, f"R{b}"]) if book else None, booking=book))
    return out


def plain(items):
    """Candidates, scores and decisions of one currency, from the rules' description."""
    days = lambda D, S: min(abs((d[6] - s[6]).days) for d in D for s in S)
    found = {}
    for block in {i[0] for i in items}:
        docs, srcs = (sorted((i for i in items if i[0] == block and i[2] == side), key=lambda i: i[3]) for side in ("DOCUMENT", "SOURCE"))
        for n, m in itertools.product(range(1, 7), range(1, 7)):
            if n + m > 7:
                continue
            for D, S in itertools.product(itertools.combinations(docs, n), itertools.combinations(srcs, m)):
                a, b = sum(d[5] for d in D), sum(s[5] for s in S)
                by_ref = n == m == 1 and D[0][7] and D[0][7] == S[0][7]
                if (abs(a - b) <= 1 or by_ref) and a * b > 0 and days(D, S) <= 7:
                    found[tuple(d[3] for d in D), tuple(s[3] for s in S)] = (D, S)
    scored = []
    for key, (D, S) in found.items():
        diff, book = sum(d[5] for d in D) - sum(s[5] for s in S), any(s[11] for s in S)
        refs, gap, points = {x[7] for x in D + S if x[7]}, days(D, S), 0
        if abs(diff) <= 1:
            points += 15 if book else 60
        if book and len(refs) == 1 and all(s[7] for s in S):
            points += 45 + 30 * any(d[8] for d in D) + 5 * (len({d[9] for d in D if d[9]}) == 1)
        band = [p for limit, p in zip((2, 4, 7), (5, 3, 1) if book else (25, 18, 10)) if gap <= limit]
        points += (band or [0])[0] + 5 * (not book and any(d[10] for d in D))
        scored.append({"key": key, "ids": set(sum(key, ())), "diff": diff, "gap": gap, "book": book, "bad": book and len(refs) > 1, "score": min(100, points), "D": D, "S": S})
    rivals = [[o for o in scored if o is not c and o["ids"] & c["ids"]] for c in scored]
    for c, others in zip(scored, rivals):
        if not c["book"] and not others:
            c["score"] = min(100, c["score"] + 10)
    out = {}
    for c, others in zip(scored, rivals):
        like = lambda x: (x["score"], abs(x["diff"]), x["gap"], len(x["ids"]))
        best = max((o["score"] for o in others), default=0)
        tie = any(like(o) == like(c) for o in others)
        auto = c["score"] >= 95 and c["score"] - best >= 15 and abs(c["diff"]) <= 1 and not tie and not c["bad"]
        facts = hashlib.sha256(json.dumps({"documents": [(x[3], x[4], x[5]) for x in c["D"]], "sources": [(x[3], x[4], x[5]) for x in c["S"]], "difference": c["diff"], "score": c["score"]}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        out[c["key"]] = (c["diff"], c["score"], best, tie, int(auto), facts, {o["key"] for o in others if o["score"] >= max(0, c["score"] - 15)})
    return out


def got(spark, items):
    sets, over = C.set_candidates(spark.createDataFrame(items, ITEMS))
    rows = C.decided_sets(C.scored_sets(sets))
    found = rows.collect()
    key = {r["candidate_id"]: (tuple(d["id"] for d in r["documents"]), tuple(s["id"] for s in r["sources"])) for r in found}
    others = {}
    for r in C.set_alternatives(rows).collect():
        others.setdefault(key[r["candidate_id"]], set()).add(key[r["other_id"]])
    assert len(found) == len(key) and all(min(100, sum(e["points"] for e in r["evidence"])) == r["score"] for r in found)
    return {key[r["candidate_id"]]: (r["difference_minor"], r["score"], r["competitor"], r["tie"], r["can_auto"], r["facts_hash"], others.get(key[r["candidate_id"]], set())) for r in found}, over.count()


@pytest.mark.parametrize("seed", [1, 2])
def test_sets(spark, seed):
    items = generated(seed)
    want = plain(items)
    assert got(spark, items) == (want, 0) and len(want) > 30 and any(len(k[0]) + len(k[1]) > 3 for k in want)


def test_named_cases(spark):
    """An exact card match is accepted, a payout with a direct link reaches 95, two like cards are not accepted, a sum of two is."""
    items = [item("a", "DOCUMENT", "i1", 10000, paid=True), item("a", "SOURCE", "c1", 10000)]
    items += [item("b", "DOCUMENT", "i2", 10000, ref="6689102875", linked=1), item("b", "SOURCE", "b1", 10000, ref="6689102875", booking=1)]
    items += [item("c", "DOCUMENT", "i3", 10000, paid=True), item("c", "SOURCE", "c2", 10000), item("c", "SOURCE", "c3", 10000)]
    items += [item("d", "DOCUMENT", "i4", 4000, paid=True), item("d", "DOCUMENT", "i5", 6000, paid=True), item("d", "SOURCE", "c4", 10000)]
    items += [item("e", "DOCUMENT", "i6", 100, 1), item("e", "SOURCE", "c5", 100, 28)]
    found, _ = got(spark, items)
    assert found == plain(items)
    assert {k: (v[1], v[4]) for k, v in found.items()} == {(("i1",), ("c1",)): (100, 1), (("i2",), ("b1",)): (95, 1), (("i3",), ("c2",)): (90, 0), (("i3",), ("c3",)): (90, 0), (("i4", "i5"), ("c4",)): (100, 1)}


def test_large_blocks(spark):
    """As far as 250,000 combinations: 1 with 24, 8 with 9; one more is reported, and no rows give none."""
    rng = random.Random(7)
    items = [item("one", "DOCUMENT", "d", 5000)] + [item("one", "SOURCE", f"s{k:02d}", 100 + 37 * k * k) for k in range(24)]
    items += [item("many", "DOCUMENT", f"m{k}", rng.randrange(100, 400)) for k in range(8)] + [item("many", "SOURCE", f"n{k}", rng.randrange(100, 400)) for k in range(9)]
    items += [item("over", "DOCUMENT", "o", 5000)] + [item("over", "SOURCE", f"p{k:02d}", 100) for k in range(26)]
    found = C.exact_combinations(spark.createDataFrame(items, ITEMS).withColumnRenamed("remaining", "amount_minor"), 1, 7).collect()
    want = {k for k in plain([i for i in items if i[0] != "over"])}
    assert {(tuple(r["docs"]), tuple(r["sources"])) for r in found if not r["over_limit"]} == want and len(want) > 20
    assert [r["block"] for r in found if r["over_limit"]] == ["over"]
    assert C.exact_combinations(spark.createDataFrame([], ITEMS).withColumnRenamed("remaining", "amount_minor"), 1, 7).count() == 0
