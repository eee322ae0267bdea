"""The index at rest against the plain search, and row numbers in two passes."""

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ledgerloom.operators import search as X
from ledgerloom.sources import files


def found(df):
    return [tuple(r) for r in df.collect()]


def test_index_after_updates(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    text = lambda: " ".join(word() for _ in range(rng.randrange(0, 9)))
    live = {f"r{i}": text() for i in range(60)} | {"none": None, "case": "ÁB Abc"}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "k string, t string")
    index = X.Index(spark, "file://" + str(tmp_path / "index")).updated(frame(live), "k", "t")
    for n in range(2):
        changed = {f"r{rng.randrange(70)}": text() for _ in range(8)}
        gone = {f"r{rng.randrange(60)}" for _ in range(4)}
        index = index.updated(frame(changed), "k", "t", spark.createDataFrame([(g,) for g in gone], "k string"))
        live = {k: v for k, v in live.items() if k not in gone} | changed
    one = index.compacted("file://" + str(tmp_path / "new"))
    for query in ("ab c", "zzz", "", "b b"):
        want = found(X.search(X.postings(frame(live), "k", "t"), query, 20)) if X._asked(query) else []
        assert found(index.search(query, 20)) == want == found(one.search(query, 20))
    assert found(X.Index(spark, "file://" + str(tmp_path / "empty")).search("a", 5)) == []


def test_a_search_reads_little(spark, tmp_path):
    """Many tokens over many row groups: the range filters reach the scan, which passes most rows over."""
    docs = spark.range(60_000).select("id", F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" all")).alias("t"))
    index = X.Index(spark, "file://" + str(tmp_path / "index"))
    index.ROW_GROUP = 1 << 15
    index = index.updated(docs, "id", "t")
    rows = index.matches(["t00001"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(token,t00001)" in plan and "LessThan(token,t00002)" in plan
    assert rows.count() == 10
    groups = []
    for path in (tmp_path / "index" / "segment=000000" / "postings").glob("*.parquet"):
        meta = pq.ParquetFile(path).metadata
        groups += [meta.row_group(g).column(0).statistics for g in range(meta.num_row_groups)]
    assert len(groups) > 10 and sum(g.min <= "t00002" and g.max >= "t00001" for g in groups) <= 2


def test_row_numbers(spark):
    """Over many splits, some of them empty, from behind a header in the middle of the first."""
    raw = spark.range(100).repartition(7).union(spark.range(0)).union(spark.range(100, 105)).withColumn("__at", F.monotonically_increasing_id()).persist()
    at = sorted(r["__at"] for r in raw.collect())
    got = sorted((r["__at"], r["row_number"]) for r in files.numbered(raw, "__at", at[4]).collect())
    assert got == [(a, n + 1) for n, a in enumerate(at[5:])]
    assert files.numbered(raw, "__at", at[-1]).count() == 0


def test_matching_rows(spark):
    """Every result of the search, without a shuffle; an empty query finds nothing."""
    docs = spark.createDataFrame([("a", "Blue Óké ring", "X"), ("b", "ok", "Y"), ("c", "book", "X"), ("d", None, "X"), ("e", "ring oke", "X")], "object_ref string, body string, kind string").withColumns({"currency": F.lit("CZK"), "day": F.lit("2026-07-01").cast("date")})
    for query in ("ok", "ok ri", "", "z"):
        rows = X.matching(docs, "body", query)
        assert sorted(r["object_ref"] for r in rows.collect()) == sorted(r["ref"] for r in X.search(X.postings(docs, "object_ref", "body"), query, 99).collect())
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [r["object_ref"] for r in X.narrow(docs, "Y", "CZK", "-07-").collect()] == ["b"]


def test_relations_each_once(spark):
    """Repeated rows and links, both ends of one kind, keys that say the same by different columns, nulls, some kinds only."""
    rows = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (1, "a/b", "c"), (1, "a", "b/c"), (2, None, "d"), (3, "e", None)], "n long, x string, y string")
    links = [(rows, "A", "n", "B", "concat(CAST(n AS STRING), '/', x)"), (rows, "C", "concat(x, '/', y)", "A", "n"), (rows, "D", "x", "E", "y"), (rows, "E", "y", "D", "x"), (rows, "F", "x", "F", "y"), (rows, "F", "y", "F", "x"), (rows, "F", "n", "F", "n")]
    plain = {n: lambda r, n=n: r[n] and str(r[n]) for n in ("n", "x", "y")} | {"concat(CAST(n AS STRING), '/', x)": lambda r: r["x"] and f"{r['n']}/{r['x']}", "concat(x, '/', y)": lambda r: r["x"] and r["y"] and f"{r['x']}/{r['y']}"}
    want = {(f"{a}:{plain[x](r)}", f"{b}:{plain[y](r)}") for _, a, x, b, y in links for r in rows.collect() if plain[x](r) and plain[y](r)}
    want |= {(q, p) for p, q in want}
    got = found(X.relations(links))
    assert len(got) == len(set(got)) and set(got) == want
    assert sorted(found(X.relations(links, ["A", "E"]))) == sorted(w for w in want if w[0][0] in "AE")
    assert X.key_columns("n", "concat(CAST(n AS STRING), '/', x)") == ["n", "x"] and X.key_columns("n", "concat(x, '/', y)") is None and X.key_columns("n", "upper(x)") is None
    alone = X.relations([(rows.select("n", "x").distinct(), *links[0][1:])])
    assert alone._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
