"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only.

Token counts of the cells (source, language, topic) are raked to the tokens that each margin's values are to keep: margin
after margin, each cell is multiplied by its margin's target over its margin's sum. No cell can keep more than it has:
cells that reach all their tokens stay there and the others of the margin make up for them. A document of a cell is kept
with probability raked / tokens, so the expected tokens are the raked ones; whether it is kept follows from a hash of its
id. A margin whose cells together have less than their target keeps them whole. Only the first step reads documents; the
cells are as many as there are combinations.
"""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MARGINS = ("source", "lang", "topic")
#: Target share of a margin's value: its share of tokens to this power, then normalised (0: all alike, 1: as it is).
POWERS = {"source": 0.0, "lang": 0.7, "topic": 0.7}
ROUNDS = 10
SHARE = 0.6
#: Cells up to this number are raked in one task and broadcast; more are shuffled by margin and joined by a shuffle.
SMALL_CELLS = 50_000
WORD = r"[^\x20\x09-\x0D]+"
#: Topics by the first pattern that a text holds.
TOPICS = (("legal", "License|Copyright|rights reserved"), ("contact", "[A-Za-z0-9]@[A-Za-z0-9]"), ("numeric", "[0-9]{6}"))
#: What every match of a topic's pattern holds.
HELD = {"contact": "@"}


def topic(text: Column) -> Column:
    """The first topic whose pattern the text holds. Patterns of plain words are looked for as words, others only in
    texts with what every match holds."""
    found = F.lit("general")
    for name, pattern in reversed(TOPICS):
        if re.fullmatch(r"[A-Za-z |]+", pattern):
            holds = reduce(operator.or_, [text.contains(word) for word in pattern.split("|")])
        else:
            holds = text.rlike(pattern)
            if name in HELD:
                holds = text.contains(HELD[name]) & holds
        found = F.when(holds, name).otherwise(found)
    return found


def with_cells(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __source, __lang, __topic (null: 'unknown') and __tokens."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.withColumns({"__source": F.coalesce(F.col("source").cast("string"), F.lit("unknown")), "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("unknown")), "__topic": topic(text), "__tokens": F.regexp_count(text, F.lit(WORD)).cast("long")})


def rake(cells: DataFrame, powers: dict = POWERS, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """cells (source, lang, topic, tokens > 0) with `raked`, at most tokens: margins at their targets where that can be,
    together `share` of all tokens; and `probability`."""
    cells = written(cells.withColumn("tokens", F.col("tokens").cast("double")), "cells")
    few = cells.count() <= SMALL_CELLS
    if few:  # one partition meets the needs of every window, so no step shuffles
        cells = cells.coalesce(1)
    total = cells.agg(F.sum("tokens")).scalar()
    rows = cells.withColumn("raked", F.col("tokens") * share)
    for m in MARGINS:
        weight = F.pow("own", F.lit(float(powers[m])))
        every = cells.groupBy(m).agg(F.sum("tokens").alias("own")).agg(F.sum(weight)).scalar()
        rows = rows.withColumn("own", F.sum("tokens").over(Window.partitionBy(m))).withColumn(f"t_{m}", weight / every * total * share).drop("own")
    for k in range(rounds):
        for m in MARGINS:
            of, full, target = Window.partitionBy(m), F.col("raked") >= F.col("tokens"), F.col(f"t_{m}")
            every, held = F.sum("raked").over(of), F.sum(F.when(full, F.col("raked")).otherwise(0.0)).over(of)
            free = F.sum(F.when(~full, F.col("raked"))).over(of)
            more = F.least("tokens", F.col("raked") * (target - held) / free)
            rows = rows.withColumn("raked", F.when(every >= target, F.col("raked") * target / every).when(full, F.col("raked")).otherwise(more))
        if k % 4 == 3:
            rows = written(rows, "cells")
            rows = rows.coalesce(1) if few else rows
    return rows.withColumn("probability", F.col("raked") / F.col("tokens"))


def draw(id_col: Column) -> Column:
    """A number from 0 to 1 that only the id decides; a null id draws as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / 4294967296.0


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", powers: dict = POWERS, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """docs with __source, __lang, __topic, __tokens, __probability and __kept.

    A null source or language is a value of its own, 'unknown'. Documents without a word (null and empty texts) have
    no weight and are kept. Rows that repeat an id share one draw. No rows give no rows; other columns pass through.
    """
    rows = with_cells(docs, text_col)
    cells = rows.groupBy(*[F.col(f"__{m}").alias(m) for m in MARGINS]).agg(F.sum("__tokens").alias("tokens")).where("tokens > 0")
    found = written(rake(cells, powers, share, rounds), "probabilities")
    found = found.select(*[F.col(m).alias(f"__{m}") for m in MARGINS], F.col("probability").alias("__probability"))
    if found.count() <= SMALL_CELLS:
        found = F.broadcast(found)
    rows = rows.join(found, [f"__{m}" for m in MARGINS], "left").withColumn("__probability", F.when(F.col("__tokens") > 0, F.col("__probability")).otherwise(1.0))
    return rows.withColumn("__kept", draw(F.col(f"`{id_col}`")) < F.col("__probability"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL, round by round."""
    topics = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS)
    steps = [
        f"d AS MATERIALIZED (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, CASE {topics} ELSE 'general' END AS topic, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens FROM documents)",
        f"c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE * {SHARE} AS raked FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for m in MARGINS:
        steps.append(f"t_{m} AS MATERIALIZED (SELECT {m}, pow(own, {POWERS[m]}) / sum(pow(own, {POWERS[m]})) OVER () * sum(own) OVER () * {SHARE} AS target FROM (SELECT {m}, sum(tokens) AS own FROM c GROUP BY {m}))")
    last = "c"
    for k in range(ROUNDS):
        for m in MARGINS:
            steps.append(f"""r{k}{m} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN every >= target THEN raked * target / every WHEN raked >= tokens THEN raked ELSE least(tokens, raked * (target - held) / free) END AS raked
                FROM (SELECT x.*, target, sum(raked) OVER w AS every, sum(CASE WHEN raked >= tokens THEN raked ELSE 0 END) OVER w AS held, sum(CASE WHEN raked < tokens THEN raked END) OVER w AS free FROM {last} x JOIN t_{m} USING ({m}) WINDOW w AS (PARTITION BY {m})))""")
            last = f"r{k}{m}"
    steps.append(f"p AS MATERIALIZED (SELECT source, lang, topic, raked / tokens AS probability FROM {last})")
    return f"""WITH {", ".join(steps)}
        SELECT doc_id, topic, n_tokens, round(CASE WHEN n_tokens > 0 THEN probability ELSE 1.0 END, 6) AS probability,
               CAST('0x' || substr(md5(doc_id::VARCHAR), 1, 8) AS BIGINT) / 4294967296.0 < CASE WHEN n_tokens > 0 THEN probability ELSE 1.0 END AS kept
        FROM d LEFT JOIN p USING (source, lang, topic)"""
