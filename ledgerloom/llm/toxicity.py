"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

A hash of the id deals the labelled training documents into those that the model is learned from and a quarter that only
calibrates it. The lexicon (words, and word beginnings that many different words share) is learned from all of the former
by document frequencies, so the calibration meets features that its own labels have not shaped. The trees and the
calibration are Spark ML's; only these are fitted on a bounded sample of labelled rows, LABELLED at most, drawn by a hash
of the id; every document is scored in one pass, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, log1p

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, pieces, written
from .ngramlm import remainder

#: Labelled rows that the trees and the calibration are fitted on, at most; terms of the lexicon, at most.
LABELLED, TERMS = 20_000, 50_000
#: A term needs this many toxic documents and this log ratio of document frequencies.
LEAST_TOXIC, LEAST_RATIO = 5, 2.5
BEGINNINGS = (4, 5, 6)
#: Second-person words of the corpus's languages (fixed values).
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes tú tus vosotros".split())
#: Signs that stand for letters (fixed values).
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})
WORD = re.compile(r"[^\W_]+")
RAW = re.compile(r"\S+")
MASKED = re.compile(r"\w[0-9@$!*]+\w|[@$*]\w")
FEATURES = ["hit_density", "hit_count", "hit_weight", "distinct_hits", "beginning_density", "beginning_count", "beginning_weight", "second_person", "proximity", "capitals", "shouted", "punctuation", "exclaimed", "obfuscated", "unmasked_hits", "length"]


def terms(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {f"{w[:n]}~" for w in words for n in BEGINNINGS if len(w) > n}


def nearest(a: list[int], b: list[int]) -> int | None:
    """The least distance of a member of a to one of b, both ascending; None where either is empty."""
    best, i, j = None, 0, 0
    while i < len(a) and j < len(b):
        apart = a[i] - b[j]
        best = abs(apart) if best is None else min(best, abs(apart))
        if apart < 0:
            i += 1
        else:
            j += 1
    return best


def features(text: str, words: dict[str, float], beginnings: dict[str, float]) -> list[float]:
    """FEATURES of one text; zeros without a word."""
    raw = WORD.findall(text)
    own = [w.lower() for w in raw]
    n = len(own)
    if not n:
        return [0.0] * len(FEATURES)
    hits = [i for i, w in enumerate(own) if w in words]
    starts = [max(b) for w in own if (b := [beginnings[k] for m in BEGINNINGS if (k := w[:m]) in beginnings and len(w) > m])] if beginnings else []
    second = [i for i, w in enumerate(own) if w in SECOND_PERSON]
    near = nearest(hits, second)
    masked = [m for m in RAW.findall(text) if MASKED.search(m)] if MASKED.search(text) else []
    unmasked = sum(any(w in words for w in WORD.findall(m.lower().translate(LEET))) for m in masked)
    letters, upper = sum(map(len, raw)), sum(1 for c in text if c.isupper()) if not text.islower() else 0
    signs = sum(text.count(c) for c in ".,;:!?")
    return [1000 * len(hits) / n, log1p(len(hits)), max((words[own[i]] for i in hits), default=0.0), float(len({own[i] for i in hits})), 1000 * len(starts) / n, log1p(len(starts)), max(starts, default=0.0), 1000 * len(second) / n, 0.0 if near is None else 1 / (1 + near), upper / letters, sum(1 for w in raw if len(w) > 1 and w.isupper()) / n, signs / n, text.count("!") / n, len(masked) / n, log1p(unmasked), log1p(n)]


def _counts(batches):
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, 2 << 20):
            seen = {0: Counter(), 1: Counter()}
            for text, toxic in zip(arrow_bytes(part.column(0)), part.column(1).to_pylist()):
                seen[toxic].update(terms(text.decode("utf-8", "replace")))
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][t] for t in names], pa.int64()), pa.array([seen[0][t] for t in names], pa.int64())], ["term", "toxic", "clean"])


def learned_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings with their log ratios from rows (text, toxic); TERMS of them at most come to the driver."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return {}, {}
    counts = sample.select("text", "toxic").mapInArrow(_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    found = counts.where(F.col("toxic") >= LEAST_TOXIC).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc(F.col("ratio") * F.log1p("toxic")), "term").limit(TERMS).collect()
    return {r["term"]: r["ratio"] for r in found if r["term"][-1] != "~"}, {r["term"][:-1]: r["ratio"] for r in found if r["term"][-1] == "~"}


def _featured(batches, lexicon):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, 2 << 20):
            x = np.array([features(t.decode("utf-8", "replace"), *lexicon) for t in arrow_bytes(part.column(part.num_columns - 1))], np.float64).reshape(-1, len(FEATURES))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], values], [*part.schema.names[:-1], "x"])


def with_features(rows: DataFrame, lexicon, kinds: str) -> DataFrame:
    """rows, whose last column is the text, with the features `x` in its place; kinds: the other columns' types."""
    return rows.mapInArrow(lambda b: _featured(b, lexicon), f"{kinds}, x array<double>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 0) -> DataFrame:
    """(id, held_out, score, predicted, raw) for each row of docs: the calibrated score, and the trees' own, which orders
    documents that the calibration holds equal.

    Labels of rows whose remainder is `held_out` are never read for fitting; where an id is labelled more than once,
    the largest label counts. Null and empty texts are scored from zero features. A null id is never labelled. With
    no labels of either class every score is the share of toxic ones (0 without any). Where the calibrating quarter has
    one class only, the trees' own score is returned. Rows that repeat an id are scored each; texts of any length are
    whole; no rows give no rows.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    rows = docs.select(docs[id_col].cast("long").alias("id"), (remainder(docs[id_col]) == held_out).alias("held_out"), docs[text_col].alias("text"))
    known = labels.select(labels["doc_id"].cast("long").alias("id"), labels["toxic"].cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").where(remainder(F.col("id")) != held_out)
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4))  # 0: calibrates only
    # The labelled texts are shuffled once, at every size alike: labels grow with the documents and are never broadcast.
    lexicon = learned_lexicon(rows.select("id", "text").join(known.where(own > 0).hint("merge"), "id").select("toxic", "text"))
    # LABELLED rows of 12 bytes at most.
    sample = rows.join(F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(LABELLED)), "id").select("id", "toxic", "text")
    fit = written(with_features(sample, lexicon, "id long, toxic int"), "features").withColumn("features", array_to_vector("x")).withColumn("label", F.col("toxic").cast("double"))
    both = {r["toxic"]: r["count"] for r in fit.groupBy("toxic").count().collect()}
    scored = with_features(rows, lexicon, "id long, held_out boolean")
    if not both.get(0) or not both.get(1):
        score = F.lit(float(both.get(1, 0) > 0))
        return scored.select("id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), score.alias("raw"))
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, seed=1, maxBins=64).fit(fit.where(own > 0).select("features", "label").coalesce(2))
    raw = vector_to_array("probability").getItem(1)
    steps = IsotonicRegression(featuresCol="raw").fit(trees.transform(fit.where(own == 0).select("features", "label")).select(raw.alias("raw"), "label")) if fit.where((own == 0)).agg(F.count_distinct("label")).first()[0] == 2 else None
    found = trees.transform(scored.withColumn("features", array_to_vector("x"))).select("id", "held_out", raw.alias("raw"))
    score = found.withColumn("score", F.col("raw"))
    if steps is not None:
        score = steps.transform(found).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))))
    return score.select("id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "raw")
