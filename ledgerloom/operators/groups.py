"""Groups of documents and sources: totals, statuses, trees, decisions and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import kept


def group_totals(members: DataFrame) -> DataFrame:
    """Totals of each group: documents and other sources, their difference, currencies and members."""
    doc = F.col("side") == "DOCUMENT"
    return members.groupBy("group_id").agg(
        F.sum(F.when(doc, F.col("amount_minor")).otherwise(0)).cast("bigint").alias("document_minor"),
        F.sum(F.when(doc, 0).otherwise(F.col("amount_minor"))).cast("bigint").alias("source_minor"),
        F.count_distinct("currency").alias("currencies"), F.count("*").alias("members"),
        F.min((F.col("method") == "AUTO").cast("int")).alias("all_auto"),
    ).withColumn("difference_minor", F.col("document_minor") - F.col("source_minor"))


def group_status(mode: Column) -> Column:
    """Status of a group with its totals; mode: AGGREGATE compares sums, DETAILED asks for both sides."""
    diff = F.col("difference_minor")
    matched = F.when(F.col("all_auto") == 1, "AUTO_MATCHED").otherwise("MANUAL_MATCHED")
    aggregate = F.when(diff == 0, "AGGREGATE_MATCHED").when(diff > 0, "UNDERPAID").otherwise("OVERPAID")
    detailed = F.when(diff == 0, matched).when(F.col("source_minor") == 0, "UNMATCHED").when(F.col("document_minor") == 0, "PARTIAL").when(diff > 0, "UNDERPAID").otherwise("OVERPAID")
    return F.when(F.col("members") == 0, "REVERSED").when(mode == "AGGREGATE", aggregate).otherwise(detailed)


def payment_status(total: Column, used: Column) -> Column:
    return F.when(used == 0, "NEUHRAZEN").when(F.abs(used) >= F.abs(total), "UHRAZEN").otherwise("ČÁSTEČNÁ ÚHRADA")


def tree_violations(edges: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(rule, group_id) of broken rules: PARENTS where a child has several parents, CYCLE where a group is above itself,
    CURRENCY where a child's currency (groups: group_id, currency) is not its parent's. edges (parent, child)."""
    own = edges.select("parent", "child").distinct()
    named = lambda rule, df, col: df.select(F.lit(rule).alias("rule"), F.col(col).cast("string").alias("group_id")).distinct()
    found = named("PARENTS", own.groupBy("child").agg(F.count("*").alias("n")).where("n > 1"), "child")
    # In a cycle every pointer goes on for ever, however often its length is doubled; above a tree all end. A group with
    # several parents follows the smallest.
    one = own.groupBy("child").agg(F.min("parent").alias("parent"))
    found = found.unionByName(named("CYCLE", _pointers(one), "node"))
    if groups is not None:
        kind = lambda a, b: groups.select(F.col("group_id").alias(a), F.col("currency").alias(b))
        mixed = own.join(kind("parent", "__p"), "parent").join(kind("child", "__c"), "child").where("__p <> __c")
        found = found.unionByName(named("CURRENCY", mixed, "child"))
    return found


def _pointers(parents: DataFrame) -> DataFrame:
    """(node) of those that are above themselves: what still has an ancestor after as many doublings as make the number of
    nodes, and is reached from one of them."""
    state = kept(parents.select(F.col("child").alias("node"), F.col("parent").alias("up")), "pointers")
    edges = state
    nodes, length = state.count() + 1, 1
    while length <= nodes and not state.isEmpty():
        state = kept(_doubled(state), "pointers")
        length *= 2
    # What is left hangs below a cycle or lies on it; pointers this long end on the cycle.
    on = kept(state.select(F.col("up").alias("node")).distinct(), "cycle")
    # A walk of all lengths from there stays on it.
    while not on.isEmpty():
        more = kept(on.unionByName(edges.join(on, "node").select(F.col("up").alias("node"))).distinct(), "cycle")
        if more.count() == on.count():
            break
        on = more
    return on


def _doubled(state: DataFrame) -> DataFrame:
    """Pointers (node, up) of twice the length, of the nodes that have ancestors so far up."""
    return state.join(state.select(F.col("node").alias("up"), F.col("up").alias("higher")), "up").select("node", F.col("higher").alias("up"))


def tree_rollup(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(root, difference_minor, groups): each group's own difference plus those of all groups below it.

    edges (parent, child); own (group_id, difference_minor). Each node holds the sum over what is less than 2^k below it
    and a pointer to its ancestor 2^k above; one round adds that sum up at the pointer's end and doubles the pointers, so
    a chain of n groups takes log2(n) rounds over rows that only get fewer. A second parent or a cycle raises an error. A
    parent need not be a group itself.
    """
    edges = kept(edges.select("parent", "child").distinct(), "edges")
    if not edges.groupBy("child").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a group has several parents")
    both = own.select(F.col("group_id").alias("root"), F.col("difference_minor").cast("bigint").alias("difference_minor"), F.lit(1).cast("bigint").alias("groups"))
    empty = edges.select(F.col("parent").alias("root"), F.lit(0).cast("bigint").alias("difference_minor"), F.lit(0).cast("bigint").alias("groups")).unionByName(edges.select(F.col("child").alias("root"), F.lit(0).cast("bigint").alias("difference_minor"), F.lit(0).cast("bigint").alias("groups")))
    add = lambda df: df.groupBy("root").agg(F.sum("difference_minor").alias("difference_minor"), F.sum("groups").alias("groups"))
    sums = kept(add(both.unionByName(empty)), "sums")
    state, length, nodes = edges.select(F.col("child").alias("node"), F.col("parent").alias("up")), 1, edges.count() + 1
    while not state.isEmpty():
        if length > nodes:
            raise ValueError("the groups hold a cycle")
        up = state.join(sums, F.col("node") == F.col("root")).select(F.col("up").alias("root"), "difference_minor", "groups")
        sums = kept(add(sums.unionByName(add(up))), "sums")
        state, length = kept(_doubled(state), "pointers"), 2 * length
    return sums.where("groups > 0")


def tree_closure(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(root, group_id): each group below each of its ancestors and itself, in log2(depth) rounds. own (group_id)."""
    state = kept(edges.select(F.col("child").alias("node"), F.col("parent").alias("up")).distinct(), "pointers")
    known, length, nodes = own.select(F.col("group_id").alias("root"), "group_id"), 1, state.count() + 1
    while not state.isEmpty():
        if length > nodes:
            raise ValueError("the groups hold a cycle")
        known = kept(known.unionByName(known.join(state, F.col("root") == F.col("node")).select(F.col("up").alias("root"), "group_id")), "closure")
        state, length = kept(_doubled(state), "pointers"), 2 * length
    return known


def revision_signature(members: DataFrame, group: str, order: list[str]) -> DataFrame:
    """(group, signature): SHA-256 of the JSON list of [content_hash, row_version] of a group's members, in this order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, "content_hash", F.col("row_version").cast("string").alias("row_version"))))
    text = F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: F.concat(F.lit('["'), r["content_hash"], F.lit('",'), r["row_version"], F.lit("]"))), ","), F.lit("]"))
    return members.groupBy(group).agg(F.sha2(text, 256).alias("signature"))


def membership_from_log(log: DataFrame) -> DataFrame:
    """Active (group_id, member): a command counts unless its latest compensation is UNDO; then the last ADD or REMOVE decides."""
    last = Window.partitionBy("command_id").orderBy(F.desc("seq"))
    effective = log.withColumn("latest", F.first("action").over(last)).where("latest <> 'UNDO' AND action NOT IN ('UNDO', 'REDO')")
    per = Window.partitionBy("group_id", "member").orderBy(F.desc("seq"))
    return effective.withColumn("n", F.row_number().over(per)).where("n = 1 AND action = 'ADD'").select("group_id", "member")


def violations(members: DataFrame) -> DataFrame:
    """Broken rules, one row each: more than one currency in a group, a member in more than one group."""
    mixed = members.groupBy("group_id").agg(F.count_distinct("currency").alias("n")).where("n > 1").select(F.lit("CURRENCIES").alias("rule"), F.col("group_id").cast("string").alias("object"))
    shared = members.groupBy("member").agg(F.count_distinct("group_id").alias("n")).where("n > 1").select(F.lit("OWNERS").alias("rule"), F.col("member").alias("object"))
    return mixed.unionByName(shared)
