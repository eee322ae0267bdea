"""Quality rules against brute force, long texts included."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality
from ledgerloom.llm.common import marked, written


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[words[i], words[i + 1], words[i + 2]] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_base_rules(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "a b c a b c d", "# <b> é\n# <b> é\n\n \n", " ".join(rng.choice("abcdefgh") for _ in range(2000))]
    texts += [" ".join(f"x{i}" for i in range(n)) + " x1 x2 x3 x4" * k for n, k in ((70_000, 1), (1_100_000, 0), (1_100_000, 1), (3_000_000, 1))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r["q"]) for r in quality.base_rules(d).select("doc_id", F.col("__q").alias("q")).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def test_verdict(spark):
    """Score and verdict, from buckets that Spark's hash gives for each token and pair of tokens."""
    rng = random.Random(2)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    texts = [" ".join(rng.choice(good if i % 2 else bad) for _ in range(80)) for i in range(60)] + [None, "", "word, WORD!"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.quality_rules(d, spark.createDataFrame([(i,) for i in range(1, 60, 2)] + [(None,)], "doc_id long")).collect()}
    tokens = {i: re.findall(r"[^\W_]+|[^\w\s]+", (t or "").lower()) for i, t in enumerate(texts)}
    keys = list({(t, "") for own in tokens.values() for t in own} | {p for own in tokens.values() for p in zip(own, own[1:])} | {(own[-1], None) for own in tokens.values() if own})
    one, two = F.xxhash64("a"), F.xxhash64("a", "b", F.lit(2))
    bucket = {(r["a"], r["b"]): r["h"] for r in spark.createDataFrame(keys, "a string, b string").select("a", "b", F.pmod(F.when(F.col("b") == "", one).otherwise(two), F.lit(quality.BUCKETS)).alias("h")).collect()}
    grams = {i: [bucket[t, ""] for t in own] + [bucket[p] for p in zip(own, own[1:])] + ([bucket[own[-1], None]] if own else []) for i, own in tokens.items()}
    raw, trusted = Counter(b for own in grams.values() for b in own), Counter(b for i in range(1, 60, 2) for b in grams[i])
    n, m = (sum(c.values()) + quality.BUCKETS for c in (raw, trusted))
    for i, own in grams.items():
        score = sum(math.log((trusted[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in own) / len(own) if own else 0.0
        assert got[i]["__score"] == pytest.approx(score, abs=1e-5)
        assert got[i]["__kept"] == (not base(texts[i])[5] and score >= quality.THRESHOLD)
    assert sum(r["__kept"] for r in got.values()) == 30


def test_marked(spark):
    """Ids by the bit map, then exactly: a full map gives the same rows."""
    ids = written(spark.range(0, 3000, 7).toDF("id"), "ids")
    rows = spark.range(0, 6000).withColumn("t", F.lit("a")).unionByName(spark.createDataFrame([(None, "b")], "id long, t string"))
    for bits in (1 << 25, 1 << 15):
        quality.marked.__globals__["MAP_BITS"] = bits
        try:
            found = marked(rows, ids)
            assert found.count() == 6001 and {r["id"] for r in found.where("marked").collect()} == set(range(0, 3000, 7))
        finally:
            quality.marked.__globals__["MAP_BITS"] = 1 << 25


def test_long_texts_in_slices(spark, monkeypatch):
    """The same figures with slices of a few characters: words, windows, lines and n-grams across slices, repeated rows."""
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choice(["a", "bb", "é#", "c-d", "long" * 9, "<x>"]) for _ in range(rng.randrange(9))) + rng.choice(["", " ", "\t\t  "]) for _ in range(40)) for _ in range(12)]
    texts += [texts[0], None, "", " " * 300, "x" * 500, " \n" * 90 + "one two three one two three" + "\n\t" * 99, "w " * 200, "end\n" * 60 + "last"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(6)], "doc_id long")
    whole = {r["doc_id"]: r for r in quality.quality_rules(d, trusted).collect()}
    assert {i: tuple(r["__q"]) for i, r in whole.items()} == {i: base(t) for i, t in enumerate(texts)}
    monkeypatch.setattr(quality, "LONG", 40)
    monkeypatch.setattr(quality, "WORD_SLICE", quality.WORD_SLICE.replace(str(quality.SLICE), "7"))
    monkeypatch.setattr(quality, "LINE_SLICE", quality.LINE_SLICE.replace(str(quality.SLICE), "7"))
    assert {r["doc_id"]: r for r in quality.quality_rules(d, trusted).collect()} == whole


def test_clashing_columns(spark):
    with pytest.raises(ValueError):
        quality.base_rules(spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, __words int"))
