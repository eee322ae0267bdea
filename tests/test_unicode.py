"""Composed accents and character references against the standard library."""

import html
import unicodedata

from pyspark.sql import functions as F

from ledgerloom.functions import unicode as U


def test_like_the_standard_library(spark):
    texts = [None, "", "plain", "é", "é", "Å 가 क़", "&eacute;", "&half; &amp;amp; &AMP &ampx; &unknown; &", "&#8364; &#128; &#x80; &#0; &#xD800; &#x110000; &#65; &#x41; &#160;", "a & b &lt;b&gt; &NotEqualTilde;", "&#1234567;"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, x string").select("k", U.composed(F.col("x")).alias("c"), U.unescape_all(F.col("x")).alias("u")).orderBy("k").collect()
    assert [r["c"] for r in got] == [t and unicodedata.normalize("NFC", t) for t in texts]
    assert [r["u"] for r in got] == [t and html.unescape(t) for t in texts]


def test_every_name(spark):
    names = [f"x {n if n.endswith(';') else n + ' '} y" for n in ("&" + k for k in html.entities.html5)]
    got = spark.createDataFrame(list(enumerate(names)), "k int, x string").select("k", U.unescape_all(F.col("x")).alias("u")).orderBy("k").collect()
    assert [r["u"] for r in got] == [html.unescape(n) for n in names]
