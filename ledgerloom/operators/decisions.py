"""Decisions over tables of candidates, groups and allocations: searches, alternatives, previews, overrides, reasons."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import changed_fields
from .matching import waterfall

#: Most lines and most different sums of a block whose subsets are counted; the targets of larger ones are reported.
MOST_LINES, MOST_SUMS = 200, 1 << 18


def helper_chain(cash: DataFrame, invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """(row_no, source_id): cash row to invoice by code, to reservation, to reference, to payout line; every hop must be the only one."""
    one = lambda df, key: df.withColumn("__n", F.count("*").over(Window.partitionBy(key))).where("__n = 1").drop("__n")
    hop = one(cash.join(invoices, "code").select("row_no", "reservation_id", "booking_reference"), "row_no").where("reservation_id IS NOT NULL AND booking_reference IS NOT NULL")
    return hop.join(one(lines.where("booking_reference IS NOT NULL"), "booking_reference"), "booking_reference").select("row_no", "source_id")


def facts_hash(*cols: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def candidate_facts(documents: Column, sources: Column, difference: Column, score: Column) -> Column:
    """SHA-256 of the facts of a candidate as JSON: members as arrays of (id, version, remaining), difference, score. Ids are ASCII."""
    members = lambda a: F.array_join(F.transform(a, lambda m: F.concat(F.lit('["'), m["id"], F.lit('",'), m["version"].cast("string"), F.lit(","), m["remaining"].cast("string"), F.lit("]"))), ",")
    return F.sha2(F.concat(F.lit('{"difference":'), difference.cast("string"), F.lit(',"documents":['), members(documents), F.lit('],"score":'), score.cast("string"), F.lit(',"sources":['), members(sources), F.lit("]}")), 256)


def candidate_id(facts: Column) -> Column:
    return F.left(F.sha2(facts, 256), F.lit(24))


def without_rejected(candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    return candidates.join(rejected.select("facts_hash"), "facts_hash", "left_anti")


def upsert_candidates(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """New snapshot of candidates: rejected ones stay so, others are open, those not found again are stale."""
    both = new.select(*keys).withColumn("__new", F.lit(1)).join(old.select(*keys, F.col("status").alias("__old")), keys, "full_outer")
    return both.select(*keys, F.when(F.col("__old") == "REJECTED", "REJECTED").when(F.col("__new").isNull(), "STALE").otherwise("OPEN").alias("status"))


def decide_candidates(candidates: DataFrame, decisions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(groups of accepted candidates, rejected facts)."""
    rows = candidates.join(decisions, keys)
    return rows.where("decision = 'ACCEPT'").withColumn("group_id", facts_hash(*keys)).select("group_id", *keys), rows.where("decision = 'REJECT'").select("facts_hash", *keys)


def alternatives(scored: DataFrame, margin: int) -> DataFrame:
    """(invoice_id, source_id, other_invoice, other_source): candidates that share a member and score at least the own score less margin."""
    o = scored.select(F.col("invoice_id").alias("other_invoice"), F.col("source_id").alias("other_source"), F.col("score").alias("other_score"))
    by = lambda a, b: scored.join(o, F.col(a) == F.col(b))
    pairs = by("invoice_id", "other_invoice").where("source_id <> other_source").unionByName(by("source_id", "other_source").where("invoice_id <> other_invoice"))
    return pairs.where(F.col("other_score") >= F.greatest(F.col("score") - margin, F.lit(0))).select("invoice_id", "source_id", "other_invoice", "other_source")


def preview(members: DataFrame) -> DataFrame:
    """For each selection of members (side, currency, remaining_minor, locked): reason and assignable amount; tests in a fixed order."""
    doc, left = F.col("side") == "DOCUMENT", F.col("remaining_minor")
    per = members.groupBy("group_id").agg(
        F.count_if(doc).alias("n_doc"), F.count_if(~doc).alias("n_src"), F.max("locked").alias("locked"), F.count_distinct("currency").alias("currencies"), F.count_if(doc & (left == 0)).alias("zero_doc"), F.count_if(~doc & (left == 0)).alias("zero_src"),
        F.count_distinct(F.signum(left)).alias("signs"), F.sum(F.when(doc, left).otherwise(0)).alias("docs"), F.sum(F.when(doc, 0).otherwise(left)).alias("srcs"),
    )
    reason = (
        F.when((F.col("n_doc") == 0) | (F.col("n_src") == 0), "EMPTY_SIDE").when(F.col("locked") == 1, "LOCKED").when(F.col("currencies") > 1, "CURRENCY").when(F.col("zero_doc") > 0, "DOCUMENT_USED")
        .when(F.col("zero_src") > 0, "SOURCE_USED").when(F.col("signs") > 1, "SIGN").when(F.col("docs") == F.col("srcs"), "EXACT").otherwise("PARTIAL")
    )
    amount = F.least(F.abs("docs"), F.abs("srcs")) * F.when(F.col("docs") > 0, 1).otherwise(-1)
    return per.select("group_id", reason.alias("reason"), F.when(reason.isin("EXACT", "PARTIAL"), amount).otherwise(0).cast("bigint").alias("assign_minor"))


def manual_settlements(log: DataFrame, docs: DataFrame) -> DataFrame:
    """(settlement_id, invoice_id, amount_minor): what each settlement in force settles, over its customer's documents of
    its currency by date and id, after the settlements before it.

    log: settlement_id, version, customer, currency, amount_minor, removed; the highest version counts, so an edit
    replaces what was settled and a removal frees it. docs: customer, currency, doc_date, invoice_id, amount_minor.
    Amounts of either sign are spread by themselves.
    """
    last = log.groupBy("settlement_id").agg(F.max_by(F.struct("customer", "currency", "amount_minor", "removed"), "version").alias("s")).select("settlement_id", "s.*").where("removed = 0")
    side = lambda df, name, *order: df.where("amount_minor <> 0").select("customer", "currency", F.signum("amount_minor").cast("int").alias("sign"), F.struct(*order).alias(name), F.abs("amount_minor").alias("amount"))
    rows = waterfall(side(docs, "doc", "doc_date", "invoice_id"), side(last, "src", "settlement_id"), ["customer", "currency", "sign"])
    return rows.select(F.col("src.settlement_id").alias("settlement_id"), F.col("doc.invoice_id").alias("invoice_id"), (F.col("amount") * F.col("sign")).alias("amount_minor"))


def object_status(total: Column, used: Column, rows: Column, all_auto: Column, included: Column, review: Column, resolved: Column, aggregate: Column) -> Column:
    """Status of an invoice or source: exclusion, then the groups' statuses, then its allocations."""
    covered = F.when(all_auto == 1, "AUTO_MATCHED").otherwise("MANUAL_MATCHED")
    return F.when(included == 0, "EXCLUDED").when(review == 1, "REVIEW_REQUIRED").when(resolved == 1, "MANUAL_RESOLVED").when(aggregate == 1, "AGGREGATE_MATCHED").when(rows == 0, "UNMATCHED").when(total == used, covered).otherwise("PARTIAL")


def latest_decisions(log: DataFrame) -> DataFrame:
    """The last decision on each object."""
    return log.groupBy("object_id").agg(F.max_by("decision", "seq").alias("decision"))


def revision_alerts(old: DataFrame, new: DataFrame, members: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """(key, fields, groups): changed watched fields of objects that are members of active groups."""
    n = new.select(key, *[F.col(c).alias(f"__{c}") for c in watched])
    rows = old.join(n, key).withColumn("fields", changed_fields({c: (F.col(c), F.col(f"__{c}")) for c in watched})).where(F.size("fields") > 0)
    return rows.join(members.groupBy(key).agg(F.sort_array(F.collect_set("group_id")).alias("groups")), key).select(key, "fields", "groups")


def leaf_members(closure: DataFrame, members: DataFrame) -> DataFrame:
    """(root, member) of all groups below each root, each member once; closure: (root, group_id)."""
    return closure.join(members.select("group_id", "member"), "group_id").select("root", "member").distinct()


def date_islands(items: DataFrame, days: int) -> DataFrame:
    """items (currency, day, ...) with `island`, the first day of the currency's run of days with gaps of at most `days`.

    Only the different days go through the window, not the items.
    """
    by = Window.partitionBy("currency").orderBy("day")
    own = items.select("currency", "day").where("day is not null").distinct()
    own = own.withColumn("start", F.when(F.coalesce(F.datediff("day", F.lag("day").over(by)) <= days, F.lit(False)), None).otherwise(F.col("day")))
    return items.join(own.select("currency", "day", F.last("start", True).over(by).alias("island")), ["currency", "day"])


def subset_sums(amounts: list[int], low: int, high: int) -> dict[int, tuple[int, int]] | None:
    """Of each sum from low to high: the number of subsets (not empty, 2 at most) and one of them as bits; None beyond MOST_SUMS."""
    found: dict[int, tuple[int, int]] = {}
    less, more = sum(a for a in amounts if a < 0), sum(a for a in amounts if a > 0)
    for k, a in enumerate(amounts):
        less, more = less - min(a, 0), more - max(a, 0)
        new = dict(found)
        for t, (n, own) in [(0, (1, 0)), *found.items()]:
            count, first = new.get(t + a, (0, own | 1 << k))
            new[t + a] = (min(2, count + n), first)
        # Sums that the lines to come cannot bring to a target.
        found = {t: x for t, x in new.items() if t + less <= high and t + more >= low}
        if len(found) > MOST_SUMS:
            return None
    return found


def unique_exact_subset(items: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, sources, over_limit): the only set of sources of the block, of any size, that sums to the target; no row where several do or none.

    Targets of a block of more than MOST_LINES sources, which is never gathered in a task, or of more than MOST_SUMS
    sums have over_limit 1 and no sources.
    """
    size = items.groupBy("block").agg(F.count("*").alias("lines"))
    known = targets.join(size, "block")
    small = items.join(size.where(F.col("lines") <= MOST_LINES), "block", "left_semi").select("block", "id", "amount_minor")
    wanted = known.where(F.col("lines") <= MOST_LINES).groupBy("block").agg(F.min("target_minor").alias("low"), F.max("target_minor").alias("high"))

    def searched(batches):
        for batch in batches:
            out = []
            for block, items, low, high in zip(*[c.to_pylist() for c in batch.columns]):
                lines = sorted(((x["id"], int(x["amount_minor"])) for x in items), key=lambda x: (-abs(x[1]), x[0]))
                sums = subset_sums([x[1] for x in lines], low, high)
                if sums is None:
                    out.append((block, None, None, 1))
                else:
                    out += [(block, t, ",".join(sorted(x[0] for k, x in enumerate(lines) if own >> k & 1)), 0) for t, (n, own) in sums.items() if n == 1]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, (pa.string(), pa.int64(), pa.string(), pa.int32()))], ["block", "target_minor", "sources", "over_limit"])

    # A block is one row with a list of at most MOST_LINES lines.
    lists = small.groupBy("block").agg(F.collect_list(F.struct("id", "amount_minor")).alias("items")).join(wanted, "block").select("block", "items", F.col("low").cast("long"), F.col("high").cast("long"))
    found = lists.mapInArrow(searched, "block string, target_minor long, sources string, over_limit int")
    exact = known.join(found.where("over_limit = 0"), ["block", "target_minor"]).select("target_id", "sources", "over_limit")
    over = known.join(found.where("over_limit = 1").select("block"), "block", "left_semi").unionByName(known.where(F.col("lines") > MOST_LINES))
    return exact.unionByName(over.select("target_id", F.lit(None).cast("string").alias("sources"), F.lit(1).alias("over_limit")))


def document_reasons(docs: DataFrame, candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """(object_id, reason) of open documents that are not settled, by the first test that fails: a reservation, its
    reference, a payout line of the reference (in the same currency), then the candidates: several, or one whose amount differs.

    docs: invoice_id, currency, reservation_id, booking_reference; candidates: invoice_id, exact (1 or 0); lines: booking_reference, currency.
    """
    per = candidates.groupBy("invoice_id").agg(F.count("*").alias("n"), F.max("exact").alias("exact"))
    line = lines.where("booking_reference IS NOT NULL").groupBy("booking_reference").agg(F.collect_set("currency").alias("currencies"))
    n, exact = F.coalesce("n", F.lit(0)), F.coalesce("exact", F.lit(0))
    reason = (
        F.when(F.col("reservation_id").isNull(), "DOCUMENT_NO_RESERVATION").when(F.col("booking_reference").isNull(), "RESERVATION_NO_BOOKING_REFERENCE").when(n > 1, "MULTIPLE_CANDIDATES")
        .when((n == 1) & (exact == 0), "AMOUNT_MISMATCH").when(F.col("currencies").isNull(), "BOOKING_REFERENCE_NOT_FOUND").when((n == 0) & ~F.array_contains("currencies", F.col("currency")), "CURRENCY_MISMATCH").when(n == 0, "HELPER_DATA_NOT_SYNCED")
    )
    rows = docs.join(per, "invoice_id", "left").join(line, "booking_reference", "left")
    return rows.select(F.col("invoice_id").alias("object_id"), reason.alias("reason")).where("reason IS NOT NULL")


def source_reasons(sources: DataFrame, used: DataFrame) -> DataFrame:
    """(object_id, reason) of sources (source_id, kind: BOOKING, BANK or CASHBOOK) that are in no candidate (source_id)."""
    rows = sources.join(used.select("source_id").distinct(), "source_id", "left_anti")
    return rows.select(F.col("source_id").alias("object_id"), F.concat("kind", F.lit("_NO_COUNTERPART")).alias("reason"))


def audit_events(old: DataFrame, new: DataFrame, key: str, watched: list[str], hide) -> DataFrame:
    """(object_ref, code, fields, before, after) for each object that a job has added, changed or removed; before and after
    are JSON of the watched columns, texts passed through `hide`; null where there was or is none."""
    shown = lambda side: F.to_json(F.struct(*[hide(F.col(f"{side}.{c}").cast("string")).alias(c) for c in watched]))
    a, b = F.col(f"a.{key}"), F.col(f"b.{key}")
    both = old.alias("a").join(new.alias("b"), a == b, "full_outer")
    fields = changed_fields({c: (F.col(f"a.{c}"), F.col(f"b.{c}")) for c in watched})
    code = F.when(a.isNull(), "ADDED").when(b.isNull(), "REMOVED").otherwise("CHANGED")
    rows = both.select(F.coalesce(a, b).alias("object_ref"), code.alias("code"), fields.alias("fields"), F.when(a.isNotNull(), shown("a")).alias("before"), F.when(b.isNotNull(), shown("b")).alias("after"))
    return rows.where("code <> 'CHANGED' OR size(fields) > 0")
