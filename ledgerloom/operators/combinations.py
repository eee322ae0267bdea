"""Combinations of several documents with several sources: search, scores, decisions and alternatives.

The search meets in the middle: the subsets of each side of a block are rows with their sums, and those of both sides are
joined by block and sum. Subsets are made from a row for each first member, so that a large block is many rows of many
tasks. A block is searched as far as the rule set goes, MOST_EXAMINED combinations of both sides, and reported beyond;
that also bounds its members.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import date_points
from .decisions import candidate_facts, candidate_id
from .matching import LEAST_MARGIN, LEAST_SCORE, TOLERANCE, WINDOW_DAYS
from .scratch import kept

#: Most members on a side (and one more in all), and most combinations of a block that the rule set looks at.
MOST_MEMBERS, MOST_EXAMINED = 6, 250_000
_SUBSETS = "block string, side string, n int, total long, mixed boolean, ids array<string>, days array<date>"


def _choose(n: Column, k: int) -> Column:
    found = F.lit(1.0)
    for i in range(k):
        found = found * F.greatest(n - i, F.lit(0))
    return found / factorial(k)


def examined(documents: Column, sources: Column) -> Column:
    """How many combinations the rule set looks at: every pair once for its reference, then every choice within the limits."""
    total = documents * sources.cast("double")
    for i in range(1, MOST_MEMBERS + 1):
        for j in range(1, MOST_MEMBERS + 2 - i):
            if j <= MOST_MEMBERS:
                total = total + _choose(documents, i) * _choose(sources, j)
    return total


def _subsets(batches):
    """Rows (block, side, members: the first one and those after it) -> the subsets that hold the first one."""
    for batch in batches:
        out = []
        for block, side, members in zip(*[c.to_pylist() for c in batch.columns]):
            first, rest = members[0], members[1:]
            for n in range(min(MOST_MEMBERS, len(members))):
                for more in combinations(rest, n):
                    own = (first, *more)
                    amounts = [x["amount_minor"] for x in own]
                    out.append((block, side, n + 1, sum(amounts), len({a > 0 for a in amounts}) > 1, [x["id"] for x in own], [x["day"] for x in own]))
        for i in range(0, len(out), 1 << 14):
            cols = list(zip(*out[i : i + (1 << 14)]))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.date32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["block", "side", "n", "total", "mixed", "ids", "days"])


def exact_combinations(items: DataFrame, tolerance: int = TOLERANCE, days: int | None = None) -> DataFrame:
    """(block, docs, sources, difference_minor, over_limit): sets of documents and sources of one block, as sorted arrays of
    ids, whose sums differ by at most tolerance and have one sign, not zero.

    items: block, side (DOCUMENT or SOURCE), id, amount_minor, with `days` also day. With `days` the sign is that of the
    two sums, and some document must lie within `days` of some source (null days never do); without it every member has
    the sign. A block in which the rule set would look at more than MOST_EXAMINED combinations is one row with over_limit
    1 and nulls; a block without both sides has no row.
    """
    doc = F.col("side") == "DOCUMENT"
    size = items.groupBy("block").agg(F.count_if(doc).alias("nd"), F.count_if(~doc).alias("ns")).where("nd > 0 AND ns > 0").withColumn("over", examined(F.col("nd"), F.col("ns")) > MOST_EXAMINED)
    day = F.col("day") if days is not None else F.lit(None).cast("date").alias("day")
    small = items.join(size.where("NOT over"), "block", "left_semi")
    # A side that is searched has few members: with one on the other side 250,000 combinations are those of 24.
    lists = small.groupBy("block", "side").agg(F.sort_array(F.collect_list(F.struct("id", F.col("amount_minor").cast("long").alias("amount_minor"), day))).alias("all"))
    firsts = lists.select("block", "side", F.posexplode("all").alias("i", "first"), "all").select("block", "side", F.slice("all", F.col("i") + 1, F.size("all")).alias("members"))
    sets = firsts.repartition(F.xxhash64("block", "side", F.col("members")[0]["id"])).mapInArrow(_subsets, _SUBSETS).where("total <> 0")
    if days is None:
        sets = sets.where("NOT mixed")
    a = sets.where("side = 'DOCUMENT'").select("block", F.col("n").alias("n_docs"), F.col("total").alias("doc_total"), F.col("ids").alias("docs"), F.col("days").alias("doc_days"), F.explode(F.sequence(F.col("total") - tolerance, F.col("total") + tolerance)).alias("total"))
    b = sets.where("side <> 'DOCUMENT'").select("block", F.col("n").alias("n_sources"), "total", F.col("ids").alias("sources"), "days")
    found = a.join(b, ["block", "total"]).where((F.col("n_docs") + F.col("n_sources") <= MOST_MEMBERS + 1) & (F.signum("doc_total") == F.signum("total")))
    if days is not None:
        found = found.where(F.exists("doc_days", lambda x: F.exists("days", lambda y: F.coalesce(F.abs(F.datediff(x, y)) <= days, F.lit(False)))))
    found = found.select("block", "docs", "sources", (F.col("doc_total") - F.col("total")).alias("difference_minor"), F.lit(0).alias("over_limit"))
    none = [F.lit(None).cast("array<string>").alias(c) for c in ("docs", "sources")]
    return found.unionByName(size.where("over").select("block", *none, F.lit(None).cast("long").alias("difference_minor"), F.lit(1).alias("over_limit")))


def _given(c: Column) -> Column:
    return F.when(c != "", c)


def scored_sets(sets: DataFrame) -> DataFrame:
    """Candidates with set_id, difference_minor, distance, size, is_booking, score (before the bonus), conflicting, evidence.

    documents: array of (id, version, remaining, day, reference, linked, internal_code, paid_at), sources: array of (id,
    version, remaining, day, reference, is_booking), both sorted by id. A payout among the sources makes it a payout's
    candidate: its points for a reference need one reference in all and every source to have it; two references conflict.
    The days apart are those of the nearest pair; unknown days give no points.
    """
    total = lambda side: F.aggregate(side, F.lit(0).cast("long"), lambda acc, m: acc + m["remaining"])
    refs = lambda side: F.transform(side, lambda m: _given(m["reference"]))
    apart = F.flatten(F.transform("documents", lambda d: F.transform("sources", lambda s: F.abs(F.datediff(d["day"], s["day"])))))
    ids = lambda side: F.transform(side, lambda m: m["id"])
    rows = sets.withColumns({
        "difference_minor": total("documents") - total("sources"), "distance": F.array_min(apart), "is_booking": F.exists("sources", lambda s: s["is_booking"] == 1),
        "references": F.array_compact(F.array_distinct(F.concat(refs("documents"), refs("sources")))), "codes": F.array_compact(F.array_distinct(F.transform("documents", lambda d: _given(d["internal_code"])))),
        "ids": F.sort_array(F.array_distinct(F.concat(ids("documents"), ids("sources")))), "set_id": F.sha2(F.to_json(F.struct(ids("documents").alias("d"), ids("sources").alias("s"))), 256),
    })
    book = F.col("is_booking")
    exact = F.abs("difference_minor") <= TOLERANCE
    same = book & (F.size("references") == 1) & F.forall("sources", lambda s: F.coalesce(s["reference"] != "", F.lit(False)))
    fact = lambda test, code, points: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), points.cast("int").alias("points")))
    rows = rows.withColumn("evidence", F.array_compact(F.array(
        fact(exact, "EXACT_AMOUNT", F.when(book, 15).otherwise(60)), fact(same, "BOOKING_ID", F.lit(45)), fact(same & F.exists("documents", lambda d: d["linked"] == 1), "DIRECT_LINK", F.lit(30)),
        fact(same & (F.size("codes") == 1), "INTERNAL_CODE", F.lit(5)), fact(book & (F.size("references") > 1), "BOOKING_CONFLICT", F.lit(0)),
        fact(F.lit(True), "DATE", F.coalesce(date_points(F.col("distance"), book), F.lit(0))), fact(~book & F.exists("documents", lambda d: d["paid_at"].isNotNull()), "PAID_AT", F.lit(5)),
    )))
    score = F.least(F.aggregate("evidence", F.lit(0), lambda acc, e: acc + e["points"]), F.lit(100))
    return rows.withColumns({"score": score.cast("int"), "conflicting": (book & (F.size("references") > 1)).cast("int"), "size": F.size("documents") + F.size("sources")}).drop("references", "codes")


def decided_sets(scored: DataFrame) -> DataFrame:
    """scored with the bonus for uniqueness (in score and evidence), competitor, tie, can_auto, facts_hash and candidate_id.

    Competitors of a candidate are the others that share a member. Each member keeps only how many of its candidates have
    which score and order; whoever holds the best score alone meets the second best. So a member of very many candidates
    is one short row, never pairs of them.
    """
    scored = kept(scored, "scored")  # several branches rest on it
    each = lambda df, *cols: df.select("set_id", *cols, F.explode("ids").alias("member"))
    held = each(scored).groupBy("member").agg(F.count("*").alias("n"))
    shared = each(scored).join(held.where("n > 1"), "member", "left_semi").select("set_id").distinct().withColumn("shared", F.lit(True))
    alone = F.col("shared").isNull() & ~F.col("is_booking")
    bonus = F.struct(F.lit("UNIQUE").alias("code"), F.lit(10).alias("points"))
    rows = scored.join(shared, "set_id", "left").withColumn("evidence", F.when(alone, F.concat("evidence", F.array(bonus))).otherwise(F.col("evidence")))
    rows = rows.withColumn("score", F.least(F.col("score") + F.when(alone, 10).otherwise(0), F.lit(100)).cast("int")).drop("shared")
    rows = kept(rows, "scored")
    order = [F.col("score"), F.abs("difference_minor").alias("off"), F.coalesce("distance", F.lit(-1)).alias("distance"), F.col("size")]
    members = each(rows, *order)
    like = members.groupBy("member", "score", "off", "distance", "size").agg(F.count("*").alias("n"))
    by_score = like.groupBy("member", "score").agg(F.sum("n").alias("n"))  # at most 101 rows a member
    best = by_score.groupBy("member").agg(F.sort_array(F.collect_list(F.struct("score", "n")), False).alias("best"))
    top, second = F.col("best")[0], F.get("best", F.lit(1))["score"]
    per = like.join(best, "member").select("member", "score", "off", "distance", "size", (F.col("n") > 1).alias("tie"), F.when((F.col("score") < top["score"]) | (top["n"] > 1), top["score"]).otherwise(second).alias("other"))
    met = members.join(per, ["member", "score", "off", "distance", "size"]).groupBy("set_id").agg(F.max("other").alias("competitor"), F.max("tie").alias("tie"))
    rows = rows.join(met, "set_id").withColumn("competitor", F.coalesce("competitor", F.lit(0)))
    auto = (F.col("score") >= LEAST_SCORE) & (F.col("score") - F.col("competitor") >= LEAST_MARGIN) & (F.abs("difference_minor") <= TOLERANCE) & ~F.col("tie") & (F.col("conflicting") == 0)
    rows = rows.withColumn("can_auto", F.when(auto, 1).otherwise(0)).withColumn("facts_hash", candidate_facts(F.col("documents"), F.col("sources"), F.col("difference_minor"), F.col("score")))
    return rows.withColumn("candidate_id", candidate_id(F.col("facts_hash")))


def set_order() -> list[Column]:
    """Total order of candidates: score, amount difference, days apart, members, ids."""
    return [F.desc("score"), F.abs("difference_minor"), F.coalesce("distance", F.lit(999_999)), F.col("size"), F.col("ids")]


def set_alternatives(decided: DataFrame, margin: int = LEAST_MARGIN) -> DataFrame:
    """(candidate_id, other_id): competitors that score at least the own score less margin; as many rows as the rule set
    lists, so a member of many like candidates has many."""
    from_side = decided.select("set_id", "candidate_id", "score", F.explode("ids").alias("member"))
    other = decided.select(F.col("set_id").alias("other_set"), F.col("candidate_id").alias("other_id"), F.col("score").alias("other_score"), F.explode("ids").alias("member"))
    pairs = from_side.join(other, "member").where((F.col("set_id") != F.col("other_set")) & (F.col("other_score") >= F.greatest(F.col("score") - margin, F.lit(0))))
    return pairs.select("candidate_id", "other_id").distinct()


def set_candidates(items: DataFrame, tolerance: int = TOLERANCE, days: int = WINDOW_DAYS) -> tuple[DataFrame, DataFrame]:
    """(candidates with documents and sources for scored_sets, blocks over the limit).

    items: block, currency, side, id, version, remaining, day, reference, linked, internal_code, paid_at, is_booking. The
    combinations of each block by amount, and pairs of equal reference, sign and within `days` whatever their amounts.
    """
    found = kept(exact_combinations(items.withColumnRenamed("remaining", "amount_minor"), tolerance, days), "combinations")
    over = found.where("over_limit = 1").select("block")
    inside = items.join(over, "block", "left_anti").where(_given(F.col("reference")).isNotNull())
    doc, src = (inside.where(F.col("side") == s).select("block", "reference", F.col("id").alias(i), F.col("day").alias(f"{i}_day"), F.signum("remaining").alias("sign")) for s, i in (("DOCUMENT", "d"), ("SOURCE", "s")))
    pairs = doc.join(src, ["block", "reference", "sign"]).where((F.abs(F.datediff("d_day", "s_day")) <= days) & (F.col("sign") != 0))
    sets = found.where("over_limit = 0").select("docs", "sources").unionByName(pairs.select(F.array("d").alias("docs"), F.array("s").alias("sources"))).distinct()
    keyed = sets.withColumn("set_key", F.sha2(F.to_json(F.struct("docs", "sources")), 256))
    one = items.drop("block").dropDuplicates(["id"])
    member = F.struct("id", "version", "remaining", "day", "reference", "linked", "internal_code", "paid_at", "is_booking")
    rows = keyed.select("set_key", F.explode(F.concat("docs", "sources")).alias("id")).join(one, "id").groupBy("set_key", "currency").agg(F.sort_array(F.collect_list(F.struct("side", member.alias("m")))).alias("all"))
    side = lambda s, drop: F.transform(F.filter("all", lambda x: x["side"] == s), lambda x: x["m"].dropFields(*drop))
    return rows.select("currency", side("DOCUMENT", ["is_booking"]).alias("documents"), side("SOURCE", ["linked", "internal_code", "paid_at"]).alias("sources")), over
