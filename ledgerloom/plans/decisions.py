"""Queries on candidates, groups and decisions."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import combinations as C
from ..operators import counterparts as P
from ..operators import decisions as D
from ..operators import groups as G
from ..operators import matching as M
from ..operators.scratch import kept
from .adapters import read
from .registry import DOC_SQL, GROUP_SQL, SCORE_SQL, SRC_SQL, USED, candidates, group_edges, query, sources, used

PAIR = ["invoice_id", "source_id"]


def scored(spark, d):
    rows = M.scored_pairs(candidates(spark, d), F.col("is_booking") == 1)
    member = lambda i, v: F.array(F.struct(F.col(i).alias("id"), F.lit(1).alias("version"), F.col(v).alias("remaining")))
    return rows.withColumn("facts_hash", D.candidate_facts(member("invoice_id", "remaining_minor"), member("source_id", "amount_minor"), F.col("remaining_minor") - F.col("amount_minor"), F.col("score")))


@query("f21_candidate_ids", f"""+{SCORE_SQL}, f AS (SELECT *, sha256('{{"difference":' || CAST(remaining_minor - amount_minor AS STRING) || ',"documents":[["' || invoice_id || '",1,' || CAST(remaining_minor AS STRING) || ']],"score":' || CAST(score AS STRING) || ',"sources":[["' || source_id || '",1,' || CAST(amount_minor AS STRING) || ']]}}') AS facts_hash FROM q) SELECT invoice_id, source_id, facts_hash, left(sha256(facts_hash), 24) AS candidate_id FROM f""", "invoice", "booking", "card")
def f21(spark, d):
    return scored(spark, d).select(*PAIR, "facts_hash", D.candidate_id(F.col("facts_hash")).alias("candidate_id"))


@query("f22_revision_signature", """+m AS (SELECT group_id, side, member, sha256(concat(member, '|', CAST(amount_minor AS STRING), '|', CAST(made_on AS STRING))) AS content_hash, amount_minor % 4 AS row_version FROM membership) SELECT group_id, sha256('[' || string_agg('["' || content_hash || '",' || CAST(row_version AS STRING) || ']', ',' ORDER BY side, member, content_hash, CAST(row_version AS STRING)) || ']') AS signature FROM m GROUP BY group_id""", "membership")
def f22(spark, d):
    """Documents first, then sources, as their names sort."""
    rows = read(spark, d, "membership").select("group_id", "side", "member", S.sha256_text(F.col("member"), F.col("amount_minor"), F.col("made_on")).alias("content_hash"), (F.col("amount_minor") % 4).alias("row_version"))
    return G.revision_signature(rows, "group_id", ["side", "member"])


@query("j9_helper_chain", "+h AS (SELECT row_no, booking_reference FROM cash_raw JOIN invoice ON code = row_no WHERE number <> '' AND booking_reference IS NOT NULL), l AS (SELECT booking_reference, min(source_id) AS source_id FROM booking WHERE booking_reference IS NOT NULL GROUP BY 1 HAVING count(*) = 1) SELECT row_no, source_id FROM h JOIN l USING (booking_reference)", "cash_raw", "invoice", "booking")
def j9(spark, d):
    cash = read(spark, d, "cash_raw").where("number <> ''").select("row_no", S.normalize_internal_code(F.col("number")).cast("bigint").alias("code"))
    return D.helper_chain(cash, read(spark, d, "invoice").select("code", "reservation_id", "booking_reference"), read(spark, d, "booking").select("booking_reference", "source_id"))


def pair_scores_sql(days: int | None) -> str:
    """All pairs of an open document and a source with their scores, then the best 20 of every document and of every source."""
    best = lambda anchor, other, kind: f"SELECT {anchor} AS anchor_id, CAST(row_number() OVER (PARTITION BY {anchor} ORDER BY score DESC, diff, days, {kind}, {other}) AS INTEGER) AS rank, {kind} AS object_kind, {other} AS object_id, score, diff FROM z QUALIFY rank <= 20"
    return f"""{DOC_SQL}, {SRC_SQL}, w AS (SELECT invoice_id, s.source_id, CAST(abs(remaining_minor - amount_minor) AS BIGINT) AS diff, abs(date_diff('day', doc_date, paid_on)) AS days, is_booking, booking_reference, source_reference, paid_at FROM d JOIN s ON d.currency = s.currency AND sign(remaining_minor) = sign(amount_minor)),
        z AS (SELECT *, CASE is_booking WHEN 1 THEN 'BOOKING' ELSE 'CARD' END AS source_kind, CAST(least(100, CASE WHEN is_booking = 1 AND booking_reference = source_reference THEN 75 ELSE 0 END + CASE WHEN diff = 0 THEN CASE is_booking WHEN 1 THEN 15 ELSE 60 END ELSE 0 END + CASE is_booking WHEN 1 THEN CASE WHEN days <= 2 THEN 5 WHEN days <= 4 THEN 3 WHEN days <= 7 THEN 1 ELSE 0 END ELSE CASE WHEN days <= 2 THEN 25 WHEN days <= 4 THEN 18 WHEN days <= 7 THEN 10 ELSE 0 END END + CASE WHEN is_booking = 0 AND paid_at IS NOT NULL THEN 5 ELSE 0 END) AS INTEGER) AS score FROM w{f" WHERE days <= {days}" if days is not None else ""})
        SELECT * FROM ({best("invoice_id", "source_id", "source_kind")}) UNION ALL SELECT * FROM ({best("source_id", "invoice_id", "'INVOICE'")})"""


def both_directions(spark, d, days: int | None):
    """The best 20 sources of every open document, and documents of every source."""
    docs = M.active_invoices(read(spark, d, "invoice")).select(F.lit("INVOICE").alias("kind"), F.col("invoice_id").alias("id"), "currency", F.col("remaining_minor").alias("amount_minor"), F.coalesce("paid_at", "doc_date").alias("day"), F.col("booking_reference").alias("reference"), F.col("paid_at").isNotNull().alias("paid"))
    src = sources(spark, d).select(F.when(F.col("is_booking") == 1, "BOOKING").otherwise("CARD").alias("kind"), F.col("source_id").alias("id"), "currency", "amount_minor", F.col("paid_on").alias("day"), F.col("source_reference").alias("reference"), F.lit(False).alias("paid"))
    docs, src = kept(docs, "documents"), kept(src, "sources")
    return P.counterparts(docs, src, days, 20).unionByName(P.counterparts(src, docs, days, 20)).drop("days")


@query("m15_counterparts", f"+{pair_scores_sql(30)}", "invoice", "booking", "card")
def m15(spark, d):
    return both_directions(spark, d, 30)


@query("j10_counterparts_any_day", f"+{pair_scores_sql(None)}", "invoice", "booking", "card")
def j10(spark, d):
    return both_directions(spark, d, None)


@query("j13_without_rejected", f"+{SCORE_SQL} SELECT invoice_id, source_id FROM q WHERE score >= 50", "invoice", "booking", "card")
def j13(spark, d):
    rows = scored(spark, d)
    return D.without_rejected(rows, rows.where("score < 50")).select(*PAIR)


@query("j14_alerts_of_groups", f"+{GROUP_SQL} SELECT alert_id, group_id, difference_minor FROM (SELECT alert_id, CAST(unnest(from_json(group_ids, '[\"VARCHAR\"]')) AS BIGINT) AS group_id FROM alert) JOIN t USING (group_id)", "alert", "membership")
def j14(spark, d):
    ids = F.coalesce(F.from_json("group_ids", "array<string>"), F.array().cast("array<string>"))
    rows = read(spark, d, "alert").select("alert_id", F.explode(F.transform(ids, lambda g: g.cast("bigint"))).alias("group_id"))
    return rows.join(G.group_totals(read(spark, d, "membership")), "group_id").select("alert_id", "group_id", "difference_minor")


def blocks(spark, d):
    doc = read(spark, d, "invoice").select("currency", "booking_reference", F.lit("DOCUMENT").alias("side"), F.col("invoice_id").alias("id"), F.col("total_minor").alias("amount_minor"))
    src = read(spark, d, "booking").select("currency", "booking_reference", F.lit("SOURCE").alias("side"), F.col("source_id").alias("id"), "amount_minor")
    return doc.unionByName(src).where("booking_reference IS NOT NULL").select(F.concat_ws("|", "currency", "booking_reference").alias("block"), "side", "id", "amount_minor")


def _examined_sql() -> str:
    choose = lambda n, k: "(" + " * ".join(f"({n} - {i})" for i in range(k)) + f" / {factorial(k)})"
    pairs = [(i, j) for i in range(1, 7) for j in range(1, 7) if i + j <= 7]
    return " + ".join(["nd * ns", *[f"{choose('nd', i)} * {choose('ns', j)}" for i, j in pairs]])


#: All subsets of at most 6 items on each side of a block b, joined by their sums; what the rule set does not search is reported.
SETS_SQL = f"""z AS (SELECT block, CAST(count(*) FILTER (side = 'DOCUMENT') AS DOUBLE) AS nd, CAST(count(*) FILTER (side = 'SOURCE') AS DOUBLE) AS ns FROM b GROUP BY block HAVING nd > 0 AND ns > 0),
    y AS (SELECT *, {_examined_sql()} > 250000 AS over FROM z), t AS (SELECT b.* FROM b JOIN y USING (block) WHERE NOT over),
    x AS (SELECT block, side, [id] AS ids, id AS last, amount_minor AS total, 1 AS n, CAST(amount_minor > 0 AS INTEGER) AS plus, [day] AS days FROM t
          UNION ALL SELECT x.block, x.side, list_append(x.ids, t.id), t.id, x.total + t.amount_minor, x.n + 1, x.plus + CAST(t.amount_minor > 0 AS INTEGER), list_append(x.days, t.day) FROM x JOIN t ON t.block = x.block AND t.side = x.side AND t.id > x.last WHERE x.n < 6),
    j AS (SELECT f.block, array_to_string(f.ids, ',') AS docs, array_to_string(s.ids, ',') AS sources, CAST(f.total - s.total AS BIGINT) AS difference_minor, f.plus IN (0, f.n) AND s.plus IN (0, s.n) AS pure, f.days AS doc_days, s.days AS source_days
          FROM x f JOIN x s ON f.block = s.block AND f.side = 'DOCUMENT' AND s.side = 'SOURCE' AND abs(f.total - s.total) <= 1 AND f.n + s.n <= 7 AND sign(f.total) * sign(s.total) > 0),
    o AS (SELECT block, CAST(NULL AS STRING) AS docs, CAST(NULL AS STRING) AS sources, CAST(NULL AS BIGINT) AS difference_minor, 1 AS over_limit FROM y WHERE over)"""
REF_SQL = "SELECT concat(currency, '|', booking_reference) AS block, 'DOCUMENT' AS side, invoice_id AS id, total_minor AS amount_minor, doc_date AS day FROM invoice WHERE booking_reference IS NOT NULL UNION ALL SELECT concat(currency, '|', booking_reference), 'SOURCE', source_id, amount_minor, paid_on FROM booking WHERE booking_reference IS NOT NULL"
ISLAND_SQL = """i AS (SELECT currency, 'DOCUMENT' AS side, invoice_id AS id, total_minor AS amount_minor, doc_date AS day FROM invoice UNION ALL SELECT currency, 'SOURCE', source_id, amount_minor, paid_on FROM booking UNION ALL SELECT currency, 'SOURCE', source_id, amount_minor, paid_on FROM card),
    g AS (SELECT currency, day, max(start) OVER (PARTITION BY currency ORDER BY day) AS island FROM (SELECT currency, day, CASE WHEN coalesce(date_diff('day', lag(day) OVER (PARTITION BY currency ORDER BY day), day) <= 7, false) THEN NULL ELSE day END AS start FROM (SELECT DISTINCT currency, day FROM i)))"""


def joined(found):
    """Members as text."""
    return found.withColumns({c: F.array_join(c, ",") for c in ("docs", "sources")})


@query("m2_reference_combinations", f"+b AS ({REF_SQL}), {SETS_SQL} SELECT block, docs, sources, difference_minor, 0 AS over_limit FROM j WHERE pure UNION ALL SELECT * FROM o", "invoice", "booking", recursive=True)
def m2(spark, d):
    """Only within a booking reference, every member of one sign."""
    return joined(C.exact_combinations(blocks(spark, d), 1))


def dated_items(spark, d):
    doc = read(spark, d, "invoice").select("currency", "booking_reference", F.lit("DOCUMENT").alias("side"), F.col("invoice_id").alias("id"), F.col("total_minor").alias("amount_minor"), F.to_date("doc_date").alias("day"))
    src = sources(spark, d).select("currency", F.col("source_reference").alias("booking_reference"), F.lit("SOURCE").alias("side"), F.col("source_id").alias("id"), "amount_minor", F.to_date("paid_on").alias("day"))
    return doc.unionByName(src)


def block_items(items, days: int):
    """items (currency, booking_reference, day, ...) in each of their blocks: a reference, a date island."""
    same = items.where("booking_reference IS NOT NULL").withColumn("block", F.concat_ws("|", "currency", "booking_reference"))
    near = D.date_islands(items, days).withColumn("block", F.concat_ws("|", "currency", F.col("island").cast("string"))).drop("island")
    return same.unionByName(near)


def all_combinations(items, tolerance: int, days: int):
    """Combinations of items (currency, booking_reference, side, id, amount_minor, day) within a reference or a date island, each once."""
    found = joined(C.exact_combinations(block_items(items, days), tolerance, days))
    once = found.where("over_limit = 0").groupBy("docs", "sources").agg(F.min("block").alias("block"), F.first("difference_minor").alias("difference_minor"), F.first("over_limit").alias("over_limit"))
    return once.unionByName(found.where("over_limit = 1")).select(found.columns)


NEAR_SQL = "len(list_filter(doc_days, lambda u: len(list_filter(source_days, lambda v: abs(date_diff('day', u, v)) <= 7)) > 0)) > 0"


@query("m2_combinations", f"+{ISLAND_SQL}, b AS ({REF_SQL} UNION ALL SELECT concat(currency, '|', CAST(island AS STRING)), side, id, amount_minor, day FROM i JOIN g USING (currency, day)), {SETS_SQL} SELECT min(block) AS block, docs, sources, min(difference_minor) AS difference_minor, 0 AS over_limit FROM j WHERE {NEAR_SQL} GROUP BY docs, sources UNION ALL SELECT * FROM o", "invoice", "booking", "card", recursive=True)
def m2_all(spark, d):
    return all_combinations(dated_items(spark, d), 1, 7)


def set_items(spark, d):
    """Open documents and all sources with what scores need, in each of their blocks."""
    none = lambda kind: F.lit(None).cast(kind)
    doc = M.active_invoices(read(spark, d, "invoice")).select("currency", "booking_reference", F.lit("DOCUMENT").alias("side"), F.col("invoice_id").alias("id"), F.col("remaining_minor").alias("remaining"), F.to_date("doc_date").alias("day"), "linked", "internal_code", F.to_date("paid_at").alias("paid_at"), F.lit(0).alias("is_booking"))
    src = sources(spark, d).select("currency", F.col("source_reference").alias("booking_reference"), F.lit("SOURCE").alias("side"), F.col("source_id").alias("id"), F.col("amount_minor").alias("remaining"), F.to_date("paid_on").alias("day"), none("int").alias("linked"), none("string").alias("internal_code"), none("date").alias("paid_at"), "is_booking")
    return block_items(doc.unionByName(src), 7).withColumns({"version": F.lit(1).cast("long"), "reference": F.col("booking_reference")}).drop("booking_reference")


def set_decisions(spark, d):
    return C.decided_sets(C.scored_sets(C.set_candidates(set_items(spark, d))[0]))


@query("m5_set_decisions")
def m5_sets(spark, d):
    """Scores, competitors, ties and decisions of candidates with any number of members."""
    shown = lambda side: F.array_join(F.transform(side, lambda m: m["id"]), ",")
    return set_decisions(spark, d).select("candidate_id", shown("documents").alias("docs"), shown("sources").alias("sources"), "difference_minor", "score", "competitor", "tie", "can_auto")


@query("m6_set_alternatives")
def m6_sets(spark, d):
    return C.set_alternatives(set_decisions(spark, d))


@query("m16_unique_reference_combination")
def m16(spark, d):
    """Targets over the limit have no sources."""
    rows = blocks(spark, d)
    targets = rows.where("side = 'DOCUMENT'").select("block", F.col("id").alias("target_id"), F.col("amount_minor").alias("target_minor"))
    return D.unique_exact_subset(rows.where("side = 'SOURCE'"), targets).select("target_id", "sources")


@query("m6_alternatives", f"+{SCORE_SQL} SELECT q.invoice_id, q.source_id, o.invoice_id AS other_invoice, o.source_id AS other_source FROM q JOIN q o ON (q.invoice_id = o.invoice_id AND q.source_id <> o.source_id OR q.source_id = o.source_id AND q.invoice_id <> o.invoice_id) AND o.score >= greatest(0, q.score - 15)", "invoice", "booking", "card")
def m6(spark, d):
    return D.alternatives(scored(spark, d).select(*PAIR, "score"), 15)


@query("m7_upsert_candidates", f"+{SCORE_SQL} SELECT invoice_id, source_id, CASE WHEN score BETWEEN 60 AND 69 THEN 'REJECTED' WHEN score < 90 THEN 'OPEN' ELSE 'STALE' END AS status FROM q", "invoice", "booking", "card")
def m7(spark, d):
    rows = scored(spark, d)
    old = rows.where("score >= 60").withColumn("status", F.when(F.col("score") < 70, "REJECTED").otherwise("OPEN"))
    return D.upsert_candidates(rows.where("score < 90"), old, PAIR)


@query("m8_accepted_groups", f"+{SCORE_SQL} SELECT sha256(concat(invoice_id, '|', source_id)) AS group_id, invoice_id, source_id FROM q WHERE score >= 90", "invoice", "booking", "card")
def m8(spark, d):
    rows = scored(spark, d)
    return D.decide_candidates(rows.drop("decision"), rows.select(*PAIR, F.when(F.col("score") >= 90, "ACCEPT").otherwise("REJECT").alias("decision")), PAIR)[0]


MANUAL_SQL = "CAST(ROUND(c_acctbal * 100) AS BIGINT)"


@query("m10_manual_source", f"+r AS (SELECT customer, invoice_id, total_minor, sum(total_minor) OVER (PARTITION BY customer ORDER BY doc_date, invoice_id) AS hi, {MANUAL_SQL} AS cash FROM invoice JOIN customer ON customer = c_custkey WHERE total_minor > 0 AND c_acctbal > 0) SELECT customer, invoice_id, CAST(least(hi, cash) - (hi - total_minor) AS BIGINT) AS amount FROM r WHERE hi - total_minor < cash", "invoice")
def m10(spark, d):
    docs = read(spark, d, "invoice").where("total_minor > 0").select("customer", F.struct("doc_date", "invoice_id").alias("doc"), F.col("total_minor").alias("amount"))
    cash = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("customer"), F.lit("MANUAL").alias("src"), F.expr(MANUAL_SQL).alias("amount"))
    return M.waterfall(docs, cash, ["customer"]).select("customer", F.col("doc.invoice_id").alias("invoice_id"), "amount")


@query("g9_manual_settlements", f"+m AS (SELECT c_custkey AS settlement_id, {MANUAL_SQL} AS amount_minor, c_nationkey % 5 = 0 AS removed FROM customer), a AS (SELECT customer, CAST(sum(total_minor) AS BIGINT) AS docs FROM invoice WHERE total_minor > 0 GROUP BY customer) SELECT settlement_id, amount_minor, CAST(greatest(0, least(amount_minor, docs)) AS BIGINT) AS allocated_minor FROM m JOIN a ON customer = settlement_id WHERE NOT removed", "invoice")
def g9(spark, d):
    docs = read(spark, d, "invoice").where("total_minor > 0").groupBy(F.col("customer").alias("settlement_id")).agg(F.sum("total_minor").alias("docs"))
    rows = read(spark, d, "customer").where("c_nationkey % 5 <> 0").select(F.col("c_custkey").alias("settlement_id"), F.expr(MANUAL_SQL).alias("amount_minor"))
    return rows.join(docs, "settlement_id").select("settlement_id", "amount_minor", F.greatest(F.lit(0).cast("bigint"), F.least("amount_minor", "docs")).alias("allocated_minor"))


@query("g9_settled_documents", f"""+l AS (SELECT c_custkey AS settlement_id, 1 AS version, c_custkey AS customer, {MANUAL_SQL} AS amount, 0 AS removed FROM customer UNION ALL SELECT c_custkey, 2, c_custkey, CAST(floor({MANUAL_SQL} / 2) AS BIGINT), 0 FROM customer WHERE c_nationkey % 3 = 0 UNION ALL SELECT c_custkey, 3, c_custkey, 0, 1 FROM customer WHERE c_nationkey % 5 = 0 UNION ALL SELECT 10000000 + c_custkey, 1, c_custkey, 5000, 0 FROM customer),
    m AS (SELECT settlement_id, customer, amount FROM l WHERE removed = 0 AND amount <> 0 AND version = (SELECT max(version) FROM l x WHERE x.settlement_id = l.settlement_id)),
    s AS (SELECT *, sign(amount) AS sg, sum(abs(amount)) OVER (PARTITION BY customer, sign(amount) ORDER BY settlement_id) AS hi FROM m), d AS (SELECT customer, invoice_id, total_minor AS amount, sign(total_minor) AS sg, sum(abs(total_minor)) OVER (PARTITION BY customer, sign(total_minor) ORDER BY doc_date, invoice_id) AS hi FROM invoice WHERE total_minor <> 0 AND currency = 'CZK')
    SELECT settlement_id, invoice_id, CAST(s.sg * (least(s.hi, d.hi) - greatest(s.hi - abs(s.amount), d.hi - abs(d.amount))) AS BIGINT) AS amount_minor FROM s JOIN d ON s.customer = d.customer AND s.sg = d.sg AND greatest(s.hi - abs(s.amount), d.hi - abs(d.amount)) < least(s.hi, d.hi)""", "invoice")
def g9_documents(spark, d):
    """Settlements in CZK: as made, edited (every third nation), removed (every fifth), and a second small one for everyone."""
    c = read(spark, d, "customer").withColumn("amount", F.expr(MANUAL_SQL))
    row = lambda df, ident, version, amount, removed: df.select(ident.alias("settlement_id"), F.lit(version).alias("version"), F.col("c_custkey").alias("customer"), F.lit("CZK").alias("currency"), amount.cast("bigint").alias("amount_minor"), F.lit(removed).alias("removed"))
    own = F.col("c_custkey")
    log = row(c, own, 1, F.col("amount"), 0).unionByName(row(c.where("c_nationkey % 3 = 0"), own, 2, F.floor(F.col("amount") / 2), 0)).unionByName(row(c.where("c_nationkey % 5 = 0"), own, 3, F.lit(0), 1)).unionByName(row(c, own + 10_000_000, 1, F.lit(5000), 0))
    return D.manual_settlements(log, read(spark, d, "invoice").select("customer", "currency", "doc_date", "invoice_id", F.col("total_minor").alias("amount_minor")))


PREVIEW_SQL = """p AS (SELECT group_id, count(*) FILTER (side = 'DOCUMENT') AS nd, count(*) FILTER (side <> 'DOCUMENT') AS ns, max(CASE WHEN method = 'MANUAL' AND group_id % 7 = 0 THEN 1 ELSE 0 END) AS locked, coalesce(sum(amount_minor) FILTER (side = 'DOCUMENT'), 0) AS docs, coalesce(sum(amount_minor) FILTER (side <> 'DOCUMENT'), 0) AS srcs FROM membership GROUP BY group_id),
    r AS (SELECT *, CASE WHEN nd = 0 OR ns = 0 THEN 'EMPTY_SIDE' WHEN locked = 1 THEN 'LOCKED' WHEN docs = srcs THEN 'EXACT' ELSE 'PARTIAL' END AS reason FROM p)"""


def previews(spark, d):
    locked = F.when((F.col("method") == "MANUAL") & (F.col("group_id") % 7 == 0), 1).otherwise(0)
    return D.preview(read(spark, d, "membership").withColumn("locked", locked).withColumn("remaining_minor", F.col("amount_minor")))


@query("m11_preview", f"+{PREVIEW_SQL} SELECT group_id, reason, CAST(CASE WHEN reason IN ('EXACT', 'PARTIAL') THEN least(docs, srcs) ELSE 0 END AS BIGINT) AS assign_minor FROM r", "membership")
def m11(spark, d):
    return previews(spark, d)


@query("g2_document_groups", f"+{PREVIEW_SQL} SELECT group_id, CASE WHEN reason = 'EXACT' THEN 'AGGREGATE' ELSE 'DETAILED' END AS mode, CAST(least(docs, srcs) AS BIGINT) AS assign_minor FROM r WHERE reason IN ('EXACT', 'PARTIAL') AND (reason = 'EXACT' OR nd = 1 OR ns = 1)", "membership")
def g2(spark, d):
    """Selections that may become groups: exact ones by their totals, others in detail unless both sides have several members."""
    n = read(spark, d, "membership").groupBy("group_id").agg(F.count_if(F.col("side") == "DOCUMENT").alias("nd"), F.count_if(F.col("side") != "DOCUMENT").alias("ns"))
    rows = previews(spark, d).join(n, "group_id").where("reason = 'EXACT' OR (reason = 'PARTIAL' AND (nd = 1 OR ns = 1))")
    return rows.select("group_id", F.when(F.col("reason") == "EXACT", "AGGREGATE").otherwise("DETAILED").alias("mode"), "assign_minor")


@query("m17_unresolved_reason", f"+{SCORE_SQL}, n AS (SELECT invoice_id, count(*) AS n FROM q GROUP BY invoice_id) SELECT invoice_id, CASE WHEN n IS NULL THEN CASE WHEN booking_reference IS NULL THEN 'HELPER_DATA_NOT_SYNCED' ELSE 'NO_CANDIDATE' END WHEN n > 1 THEN 'SEVERAL_CANDIDATES' ELSE 'ONE_CANDIDATE' END AS reason FROM d LEFT JOIN n USING (invoice_id)", "invoice", "booking", "card")
def m17(spark, d):
    n = candidates(spark, d).groupBy("invoice_id").agg(F.count("*").alias("n"))
    reason = F.when(F.col("n").isNull(), F.when(F.col("booking_reference").isNull(), "HELPER_DATA_NOT_SYNCED").otherwise("NO_CANDIDATE")).when(F.col("n") > 1, "SEVERAL_CANDIDATES").otherwise("ONE_CANDIDATE")
    return M.active_invoices(read(spark, d, "invoice")).join(n, "invoice_id", "left").select("invoice_id", reason.alias("reason"))


@query("m18_strong_identifier", f"+{DOC_SQL}, {SRC_SQL}, p AS (SELECT invoice_id, source_id, CASE WHEN code = CAST(substr(source_id, 2, 10) AS BIGINT) THEN 0 ELSE 1 END AS weak, abs(date_diff('day', doc_date, paid_on)) AS days FROM d JOIN s ON d.currency = s.currency AND is_booking = 0 AND abs(remaining_minor - amount_minor) <= 1 AND sign(remaining_minor) = sign(amount_minor) AND abs(date_diff('day', doc_date, paid_on)) <= 7) SELECT invoice_id, source_id, weak FROM p QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY weak, days, source_id) = 1", "invoice", "booking", "card")
def m18(spark, d):
    """The card row of each invoice: an equal identifier goes before a nearer date."""
    pairs = M.amount_pairs(M.active_invoices(read(spark, d, "invoice")), sources(spark, d).where("is_booking = 0"))
    rows = pairs.withColumn("weak", F.when(F.expr("code = CAST(substr(source_id, 2, 10) AS BIGINT)"), 0).otherwise(1)).withColumn("days", F.abs(F.datediff("doc_date", "paid_on")))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("invoice_id").orderBy("weak", "days", "source_id"))).where("n = 1").select("invoice_id", "source_id", "weak")


@query("t7_revision_alerts", "SELECT o_orderkey AS object_id, CASE WHEN o_orderkey % 6 = 0 THEN 'status,priority' WHEN o_orderkey % 2 = 0 THEN 'status' ELSE 'priority' END AS fields, count(DISTINCT l_suppkey) AS groups FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 GROUP BY o_orderkey")
def t7(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("object_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    k = F.col("object_id")
    new = o.withColumn("status", F.when(k % 2 == 0, "changed").otherwise(F.col("status"))).withColumn("priority", F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("priority")))
    members = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("object_id"), F.col("l_suppkey").alias("group_id"))
    return D.revision_alerts(o, new, members, "object_id", ["status", "priority"]).select("object_id", F.array_join("fields", ",").alias("fields"), F.size("groups").cast("bigint").alias("groups"))


LOG_SQL = "l AS (SELECT user_id AS object_id, arg_max(event_type, event_id) AS decision FROM events GROUP BY user_id)"


def decision_log(spark, d):
    return D.latest_decisions(read(spark, d, "events").select(F.col("user_id").alias("object_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("decision")))


@query("t8_revalidated_groups", f"+{LOG_SQL}, {GROUP_SQL} SELECT group_id, CASE WHEN decision = 'error' THEN 'REVIEW_REQUIRED' WHEN difference_minor = 0 THEN 'AGGREGATE_MATCHED' WHEN difference_minor > 0 THEN 'UNDERPAID' ELSE 'OVERPAID' END AS status, CASE decision WHEN 'error' THEN 'OPEN' WHEN 'click' THEN 'REOPENED' ELSE 'REVALIDATED' END AS alert FROM t JOIN l ON object_id = group_id", "membership")
def t8(spark, d):
    rows = G.group_totals(read(spark, d, "membership")).join(decision_log(spark, d), F.col("object_id") == F.col("group_id"))
    status = F.when(F.col("decision") == "error", "REVIEW_REQUIRED").otherwise(G.group_status(F.lit("AGGREGATE")))
    return rows.select("group_id", status.alias("status"), F.when(F.col("decision") == "error", "OPEN").when(F.col("decision") == "click", "REOPENED").otherwise("REVALIDATED").alias("alert"))


@query("g10_overrides", f"+{LOG_SQL} SELECT invoice_id, CASE decision WHEN 'click' THEN 'EXCLUDED' WHEN 'error' THEN 'MANUAL_RESOLVED' ELSE 'OPEN' END AS status, CASE WHEN decision = 'error' THEN 1 ELSE 0 END AS locked FROM invoice LEFT JOIN l ON object_id = code", "invoice")
def g10(spark, d):
    rows = read(spark, d, "invoice").join(decision_log(spark, d), F.col("object_id") == F.col("code"), "left")
    return rows.select("invoice_id", F.when(F.col("decision") == "click", "EXCLUDED").when(F.col("decision") == "error", "MANUAL_RESOLVED").otherwise("OPEN").alias("status"), F.when(F.col("decision") == "error", 1).otherwise(0).alias("locked"))


@query("g4_entity_status", f"+u AS (SELECT invoice_id, sum(amount_minor) AS used_minor, count(*) AS n, min(CAST(method = 'AUTO' AS INTEGER)) AS all_auto FROM allocation WHERE active = 1 GROUP BY invoice_id), {LOG_SQL} SELECT invoice_id, CASE WHEN included = 0 THEN 'EXCLUDED' WHEN decision = 'click' THEN 'REVIEW_REQUIRED' WHEN decision = 'error' THEN 'MANUAL_RESOLVED' WHEN n IS NULL THEN 'UNMATCHED' WHEN total_minor = used_minor THEN CASE all_auto WHEN 1 THEN 'AUTO_MATCHED' ELSE 'MANUAL_MATCHED' END ELSE 'PARTIAL' END AS status FROM invoice LEFT JOIN u USING (invoice_id) LEFT JOIN l ON object_id = code", "invoice", "allocation")
def g4(spark, d):
    u = read(spark, d, "allocation").where("active = 1").groupBy("invoice_id").agg(F.sum("amount_minor").alias("used_minor"), F.count("*").alias("n"), F.min((F.col("method") == "AUTO").cast("int")).alias("all_auto"))
    rows = read(spark, d, "invoice").join(u, "invoice_id", "left").join(decision_log(spark, d), F.col("object_id") == F.col("code"), "left")
    is_ = lambda x: F.when(F.col("decision") == x, 1).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    status = D.object_status(F.col("total_minor"), zero("used_minor"), zero("n"), zero("all_auto"), F.col("included"), is_("click"), is_("error"), F.lit(0))
    return rows.select("invoice_id", status.alias("status"))


@query("g6_leaf_members", "+c AS (SELECT DISTINCT CAST(floor(group_id / 100) AS BIGINT) AS root, group_id FROM membership UNION SELECT DISTINCT CAST(floor(group_id / 10) AS BIGINT), group_id FROM membership) SELECT DISTINCT root, member FROM c JOIN membership USING (group_id)", "membership")
def g6(spark, d):
    m = read(spark, d, "membership")
    up = lambda n: F.floor(F.col("group_id") / n).cast("bigint")
    return D.leaf_members(m.select(F.explode(F.array(up(100), up(10))).alias("root"), "group_id").distinct(), m)


@query("g6_leaf_members_of_all", "+g AS (SELECT DISTINCT group_id FROM membership), c AS (SELECT CAST(floor(group_id / pow(10, i)) AS BIGINT) AS root, group_id FROM g, unnest(generate_series(0, length(CAST(group_id AS STRING)) - 1)) AS s(i)) SELECT DISTINCT root, member FROM c JOIN membership USING (group_id)", "membership")
def g6_all(spark, d):
    """Members below every group of the tree of g5."""
    m = read(spark, d, "membership")
    return D.leaf_members(G.tree_closure(group_edges(m), m.select("group_id").distinct()), m)


@query("g5_tree_violations", "+g AS (SELECT group_id, min(currency) AS currency FROM membership GROUP BY group_id) SELECT 'CURRENCY' AS rule, CAST(c.group_id AS STRING) AS group_id FROM g c JOIN g p ON p.group_id = CAST(floor(c.group_id / 10) AS BIGINT) AND c.group_id >= 10 AND p.currency <> c.currency", "membership")
def g5_violations(spark, d):
    m = read(spark, d, "membership")
    return G.tree_violations(group_edges(m), m.groupBy("group_id").agg(F.min("currency").alias("currency")))


@query("m17_reasons_of_items", f"""+{SCORE_SQL}, {GROUP_SQL}, n AS (SELECT invoice_id, count(*) AS n, max(CASE WHEN abs(remaining_minor - amount_minor) <= 1 THEN 1 ELSE 0 END) AS exact FROM q GROUP BY invoice_id), y AS (SELECT booking_reference, list(DISTINCT currency) AS cs FROM booking WHERE booking_reference IS NOT NULL GROUP BY 1),
    r AS (SELECT invoice_id AS object_id, CASE WHEN d.booking_reference IS NULL THEN 'RESERVATION_NO_BOOKING_REFERENCE' WHEN n > 1 THEN 'MULTIPLE_CANDIDATES' WHEN n = 1 AND exact = 0 THEN 'AMOUNT_MISMATCH' WHEN cs IS NULL THEN 'BOOKING_REFERENCE_NOT_FOUND' WHEN n IS NULL AND NOT list_contains(cs, currency) THEN 'CURRENCY_MISMATCH' WHEN n IS NULL THEN 'HELPER_DATA_NOT_SYNCED' END AS reason FROM d LEFT JOIN n USING (invoice_id) LEFT JOIN y ON d.booking_reference = y.booking_reference)
    SELECT * FROM r WHERE reason IS NOT NULL UNION ALL SELECT source_id, CASE WHEN is_booking = 1 THEN 'BOOKING_NO_COUNTERPART' ELSE 'BANK_NO_COUNTERPART' END FROM s WHERE source_id NOT IN (SELECT source_id FROM q)
    UNION ALL SELECT concat('K', CAST(c.movement_id AS STRING)), 'CASHBOOK_NO_COUNTERPART' FROM movement c WHERE kind = 'CASHBOOK' AND NOT EXISTS (SELECT 1 FROM movement m WHERE m.kind IN ('CARD', 'BOOKING') AND m.currency = c.currency AND m.amount_minor = c.amount_minor AND abs(date_diff('day', c.day, m.day)) <= 2)
    UNION ALL SELECT concat('N', CAST(row_no AS STRING)), 'CASHBOOK_NO_DOCUMENT' FROM cash_raw WHERE number = '' UNION ALL SELECT concat('G', CAST(group_id AS STRING)), 'OPEN_AGGREGATE' FROM t WHERE difference_minor <> 0""", "invoice", "booking", "card", "movement", "cash_raw", "membership")
def m17_items(spark, d):
    """Reasons of every kind of item: documents, sources, cash-book rows with and without a number, open groups."""
    pairs = candidates(spark, d)
    docs = D.document_reasons(M.active_invoices(read(spark, d, "invoice")), pairs.select("invoice_id", (F.abs(F.col("remaining_minor") - F.col("amount_minor")) <= 1).cast("int").alias("exact")), read(spark, d, "booking"))
    src = D.source_reasons(sources(spark, d).withColumn("kind", F.when(F.col("is_booking") == 1, "BOOKING").otherwise("BANK")), pairs)
    m = read(spark, d, "movement")
    cash = m.where("kind = 'CASHBOOK'").select(F.col("movement_id").alias("source_id"), "currency", "amount_minor", F.col("day").alias("cash_day"))
    other = m.where("kind IN ('CARD', 'BOOKING')").select("currency", "amount_minor", F.col("day").alias("other_day"))
    alone = D.source_reasons(cash.withColumn("kind", F.lit("CASHBOOK")), M.near_days(cash, other, "cash_day", "other_day", ["currency", "amount_minor"], 2)).withColumn("object_id", F.concat(F.lit("K"), F.col("object_id").cast("string")))
    code = S.normalize_internal_code(F.col("number")).try_cast("bigint")
    rows = read(spark, d, "cash_raw").withColumn("code", code).join(read(spark, d, "invoice").select("code"), "code", "left_anti").select(F.concat(F.lit("N"), F.col("row_no").cast("string")).alias("object_id"), F.lit("CASHBOOK_NO_DOCUMENT").alias("reason"))
    groups = G.group_totals(read(spark, d, "membership")).where("difference_minor <> 0").select(F.concat(F.lit("G"), F.col("group_id").cast("string")).alias("object_id"), F.lit("OPEN_AGGREGATE").alias("reason"))
    return docs.unionByName(src).unionByName(alone).unionByName(rows).unionByName(groups)


@query("g14_audit_events", """SELECT o_orderkey AS object_ref, CASE WHEN o_orderkey % 7 = 0 THEN 'ADDED' WHEN o_orderkey % 5 = 0 THEN 'REMOVED' ELSE 'CHANGED' END AS code, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 'status,mail' ELSE 'status' END AS fields,
    CASE WHEN o_orderkey % 7 <> 0 THEN concat('{"status":"', o_orderstatus, '","mail":"***@***"}') END AS before, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 <> 0 THEN concat('{"status":"', CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END, '","mail":"***@***"}') END AS after FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0""")
def g14_audit(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@mail.cz")).alias("mail"))
    k = F.col("o_orderkey")
    new = o.where((k % 7 == 0) | (k % 5 != 0)).withColumn("status", F.when(k % 3 == 0, "X").otherwise(F.col("status")))
    return D.audit_events(o.where(k % 7 != 0), new, "o_orderkey", ["status", "mail"], S.redact).withColumn("fields", F.array_join("fields", ","))
