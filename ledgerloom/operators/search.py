"""Token postings, ranked prefix search and the object graph."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import without_accents

K1, B = 1.2, 0.75


def _tokens(text: str) -> Column:
    return F.regexp_extract_all(without_accents(F.coalesce(F.col(text), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def postings(docs: DataFrame, ref: str, text: str) -> DataFrame:
    """(token, ref, hits) of accent-free, lower-case tokens."""
    return docs.select(F.col(ref).alias("ref"), F.explode(_tokens(text)).alias("token")).groupBy("token", "ref").agg(F.count("*").alias("hits"))


def search_documents(kinds: dict[str, tuple[DataFrame, str, list[str], str, str]]) -> DataFrame:
    """(object_ref, kind, body, currency, day) of every kind of object: its table, key, texts, currency and date as expressions."""
    parts = [df.select(F.concat(F.lit(f"{kind}:"), F.expr(key).cast("string")).alias("object_ref"), F.lit(kind).alias("kind"), F.concat_ws(" ", *[F.expr(t).cast("string") for t in texts]).alias("body"), F.expr(currency).cast("string").alias("currency"), F.expr(day).cast("date").alias("day")) for kind, (df, key, texts, currency, day) in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


def key_columns(x: str, y: str) -> list[str] | None:
    """Columns that two key expressions are made of, if equal pairs of keys have equal columns: each is a key by itself or
    the only other one in a concat() of columns and separators. None: that can't be told."""
    plain = {k for k in (x, y) if re.fullmatch(r"\w+", k)}
    names = set(plain)
    for key in {x, y} - plain:
        call = re.fullmatch(r"concat\((.*)\)", key)
        parts = [re.fullmatch(r"\s*(?:CAST\((\w+) AS STRING\)|(\w+)|'[^'\w]*')\s*", p) for p in call[1].split(",")] if call else [None]
        own = [p[1] or p[2] for p in parts if p and (p[1] or p[2])]
        if None in parts or len([c for c in own if c not in plain]) > 1:
            return None
        names |= set(own)
    return sorted(names)


def relations(links: list[tuple[DataFrame, str, str, str, str]], of: list[str] | None = None) -> DataFrame:
    """(object_ref, related_ref) in both directions, each once, of link tables: kind and key expression of either end. With
    `of` only from objects of these kinds.

    Only links between the same two kinds can say the same. A link that is alone with its kinds is made unique by the
    columns of its keys, once for both directions: these are shorter than the keys, and a table that is unique by them
    already is not shuffled again.
    """
    ref = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.expr(key).cast("string"))
    groups: dict[frozenset, list] = {}
    for link in links:
        if of is None or {link[1], link[3]} & set(of):
            groups.setdefault(frozenset((link[1], link[3])), []).append(link)
    found = []
    for kinds, same in groups.items():
        df, a, x, b, y = same[0]
        cols = key_columns(x, y)
        if len(same) == 1 and a != b and cols is not None:
            rows = df.select(*cols).distinct().select(ref(a, x).alias("x"), ref(b, y).alias("y"))
            ways = [("x", "y")] * (of is None or a in of) + [("y", "x")] * (of is None or b in of)
        else:  # in the order of the kinds' names, so that equal pairs are equal rows
            ends = [((a, x), (b, y)) if a <= b else ((b, y), (a, x)) for _, a, x, b, y in same]
            rows = reduce(DataFrame.unionByName, [link[0].select(ref(*p).alias("x"), ref(*q).alias("y")) for link, (p, q) in zip(same, ends)])
            if len(kinds) == 1:
                rows = rows.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), (F.col("x").isNull() | F.col("y").isNull()).alias("gone")).where("NOT gone").drop("gone")
            rows = rows.distinct()
            ways = [("x", "y")] * (of is None or min(kinds) in of) + [("y", "x")] * (of is None or max(kinds) in of)
        rows = rows.where("x IS NOT NULL AND y IS NOT NULL")
        pair = lambda p, q: F.struct(F.col(p).alias("object_ref"), F.col(q).alias("related_ref"))
        pairs = F.array_distinct(F.array(*[pair(p, q) for p, q in ways])) if len(kinds) == 1 else F.array(*[pair(p, q) for p, q in ways])
        found.append(rows.select(F.explode(pairs).alias("r")).select("r.object_ref", "r.related_ref"))
    return reduce(DataFrame.unionByName, found)


def related(edges: DataFrame, asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(asked_ref, related_ref, kind, body): the objects next to each asked one (object_ref)."""
    near = edges.join(asked.select("object_ref").distinct(), "object_ref").select(F.col("object_ref").alias("asked_ref"), F.col("related_ref").alias("object_ref"))
    return near.join(docs.select("object_ref", "kind", "body"), "object_ref").select("asked_ref", F.col("object_ref").alias("related_ref"), "kind", "body")


def narrow(docs: DataFrame, kind: str | None = None, currency: str | None = None, day: str | None = None) -> DataFrame:
    """Rows of docs (kind, currency, day) of one kind or currency, or with a part of the date's text."""
    for test in ([F.col("kind") == kind] if kind else []) + ([F.col("currency") == currency] if currency else []) + ([F.col("day").cast("string").contains(day)] if day else []):
        docs = docs.where(test)
    return docs


def narrowed(found: DataFrame, docs: DataFrame, kind: str | None = None, currency: str | None = None, day: str | None = None) -> DataFrame:
    """Search results (ref, score) of one kind or currency, or with a part of the date's text."""
    return narrow(found.join(docs, found["ref"] == docs["object_ref"]), kind, currency, day).select("ref", "kind", "score")


def matching(docs: DataFrame, text: str, query: str) -> DataFrame:
    """The rows of docs that search() would find, where every result is wanted and none is ranked: each row is judged where
    it is, so nothing is shuffled. An empty query finds nothing."""
    tokens = _tokens(text)
    held = lambda asked: F.exists(tokens, lambda t: t.startswith(asked))
    tests = [held(a) for a in _asked(query)]
    return docs.where(reduce(lambda x, y: x & y, tests)) if tests else docs.where(F.lit(False))


def _asked(query: str) -> list[str]:
    return sorted(set(re.findall("[a-z0-9]+", query.lower())))


def _ranked(hit: DataFrame, docs, mean, asked: list[str], limit: int) -> DataFrame:
    """(ref, score) from rows (ref, asked, tf, size) of the matches; docs and mean: literals, or columns of every row."""
    df = hit.groupBy("asked").agg(F.count("*").alias("df"))  # one row for each asked token
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    points = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
    found = hit.join(F.broadcast(df), "asked").groupBy("ref").agg(F.sum(points).alias("score"), F.count("*").alias("n")).where(F.col("n") == len(asked))
    return found.select("ref", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "ref").limit(limit)


def _prefixed(post: DataFrame, asked: list[str], *more: str) -> DataFrame:
    """(ref, asked, tf): how often each ref holds tokens that begin with each asked one."""
    match = F.filter(F.array(*[F.lit(a) for a in asked]), lambda a: F.col("token").startswith(a))
    return post.select("ref", "hits", *more, F.explode(match).alias("asked")).groupBy("ref", "asked", *more).agg(F.sum("hits").alias("tf"))


def search(post: DataFrame, query: str, limit: int) -> DataFrame:
    """Refs that hold every token of the query as a prefix, by BM25."""
    asked = _asked(query)
    size = post.groupBy("ref").agg(F.sum("hits").alias("size"))
    stats = size.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))
    hit = _prefixed(post, asked).join(size, "ref").join(F.broadcast(stats))
    return _ranked(hit, F.col("docs"), F.col("mean"), asked, limit)


class Index:
    """Postings at rest, in segments: each is sorted by token over its files and small row groups, so that a search reads
    the ranges of its prefixes and nothing else.

    An update writes a segment with the postings of the changed objects only; what older segments say of an object that a
    later one names is passed over. Every posting carries its object's size, and every segment the totals of all objects
    after it, so a search reads neither all sizes nor all postings. A segment counts once its totals are there, which are
    written last; one writer at a time. `compacted` makes one segment of all.
    """

    #: Bytes of a row group: about what a prefix range costs at least.
    ROW_GROUP = 1 << 20
    POSTINGS, SIZES, TOTALS = "token string, ref string, hits long, size long", "ref string, size long", "docs long, total long"

    def __init__(self, spark: SparkSession, folder: str, segments: int = 0):
        self.spark, self.folder, self.segments = spark, folder.rstrip("/"), segments

    def _path(self, n: int, name: str) -> str:
        return f"{self.folder}/segment={n:06d}/{name}"

    def _read(self, n: int, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path(n, name))

    def _live(self, name: str, schema: str, test=None) -> DataFrame:
        """The rows of all segments that no later one replaces."""
        parts = []
        for n in range(self.segments):
            rows = self._read(n, name, schema)
            rows = rows.where(test) if test is not None else rows
            later = [self._read(m, "sizes", self.SIZES).select("ref") for m in range(n + 1, self.segments)]
            parts.append(rows.join(reduce(DataFrame.union, later).distinct(), "ref", "left_anti") if later else rows)
        return reduce(DataFrame.unionByName, parts)

    def updated(self, docs: DataFrame, ref: str, text: str, removed: DataFrame | None = None) -> Index:
        """The index after the objects of docs have been added or changed, and those of removed (a column of refs) left out.
        Objects without a token stay known, with size 0."""
        n = self.segments
        rows = postings(docs.select(F.col(ref).cast("string").alias("ref"), F.col(text).alias("text")), "ref", "text")
        size = rows.groupBy("ref").agg(F.sum("hits").alias("size"))
        named = docs.select(F.col(ref).cast("string").alias("ref")).distinct().join(size, "ref", "left")
        named = named if removed is None else named.unionByName(removed.select(F.col(removed.columns[0]).cast("string").alias("ref"), F.lit(None).cast("long").alias("size")).join(named.select("ref"), "ref", "left_anti"))
        named.select("ref", F.coalesce("size", F.lit(0).cast("long")).alias("size")).write.parquet(self._path(n, "sizes"))
        known = self._read(n, "sizes", self.SIZES)
        rows = rows.join(known, "ref").select("token", "ref", "hits", "size").repartitionByRange("token", "ref").sortWithinPartitions("token", "ref")
        rows.write.option("parquet.block.size", self.ROW_GROUP).parquet(self._path(n, "postings"))
        after = Index(self.spark, self.folder, n + 1)
        after._live("sizes", self.SIZES).where("size > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("total")).write.parquet(self._path(n, "totals"))
        return after

    def compacted(self, folder: str) -> Index:
        """All of it as the one segment of a new folder."""
        new = Index(self.spark, folder, 1)
        self._live("sizes", self.SIZES).where("size > 0").write.parquet(new._path(0, "sizes"))
        self._live("postings", self.POSTINGS).repartitionByRange("token", "ref").sortWithinPartitions("token", "ref").write.option("parquet.block.size", self.ROW_GROUP).parquet(new._path(0, "postings"))
        self._read(self.segments - 1, "totals", self.TOTALS).write.parquet(new._path(0, "totals"))
        return new

    def matches(self, asked: list[str]) -> DataFrame:
        """Live postings of tokens that begin with one of asked, as ranges that the scan can use."""
        ranges = [(F.col("token") >= a) & (F.col("token") < a[:-1] + chr(ord(a[-1]) + 1)) for a in asked]
        return self._live("postings", self.POSTINGS, reduce(lambda x, y: x | y, ranges))

    def search(self, query: str, limit: int) -> DataFrame:
        """As search(): refs that hold every token of the query as a prefix, by BM25; an empty query finds nothing."""
        asked = _asked(query)
        total = self._read(self.segments - 1, "totals", self.TOTALS).first() if self.segments else None  # one row
        if not asked or total is None or not total["docs"]:
            return self.spark.createDataFrame([], "ref string, score double")
        return _ranked(_prefixed(self.matches(asked), asked, "size"), F.lit(float(total["docs"])), F.lit(total["total"] / total["docs"]), asked, limit)
