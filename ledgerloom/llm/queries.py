"""The registered queries of this subpackage: each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import mixing
from .common import shown_id, table


def op1_simhash(spark, sf_dir):
    from .simhash import simhash_near_duplicates

    found = simhash_near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(shown_id().alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), shown_id("component").alias("component_id"))


def op4_line_dedup(spark, sf_dir):
    from .linededup import line_digests, line_keep_bitmaps

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_digests(docs, line_keep_bitmaps(docs)).withColumnRenamed("id", "doc_id")


def op10_byte_bpe(spark, sf_dir):
    from .bpe import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op6_lm_scoring(spark, sf_dir):
    from .ngramlm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_repeated_passages(spark, sf_dir):
    from .repeats import repeat_digests

    found = repeat_digests(table(spark, sf_dir, "documents")).withColumn("id", shown_id()).withColumnRenamed("id", "doc_id")
    return found.withColumn("repeated", F.col("n_removed") > 0)


def op3_quality_rules(spark, sf_dir):
    from .quality import quality_rules, trusted_ids

    rows = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted_ids(spark, sf_dir))
    return rows.select("doc_id", "__q.*", F.col("__kept").alias("kept"), F.col("__score").alias("llr_per_ngram"))


def op7_source_mixing(spark, sf_dir):
    rows = mixing.mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.round("__probability", 6).alias("probability"), F.col("__kept").alias("kept"))


def op2_html_extraction(spark, sf_dir):
    from .htmltext import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_embedding_pq(spark, sf_dir):
    from .embeddings import embedding_near_duplicates

    found = embedding_near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(shown_id().alias("vec_id"), "n_links", shown_id("component").alias("component_id"), "kept")


def op5_toxicity(spark, sf_dir):
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op11_ranked_search(spark, sf_dir):
    from .lexical import ranked_search

    found = ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op12_decontamination(spark, sf_dir):
    from .decontam import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op13_token_alignment(spark, sf_dir):
    from .align import token_alignment

    return token_alignment(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op5_toxicity": op5_toxicity,
    "op2_html_extraction": op2_html_extraction,
    "op8_embedding_pq": op8_embedding_pq,
    "op3_quality_rules": op3_quality_rules,
    "op7_source_mixing": op7_source_mixing,
    "op6_lm_scoring": op6_lm_scoring,
    "op9_repeated_passages": op9_repeated_passages,
    "op4_line_dedup": op4_line_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op1_simhash": op1_simhash,
    "op11_ranked_search": op11_ranked_search,
    "op12_decontamination": op12_decontamination,
    "op13_token_alignment": op13_token_alignment,
}

#: A-Z lower-cased without touching other letters.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Words of the searches, of a lower-cased text.
WORDS = f"regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op11_ranked_search": f"""
        WITH l AS (SELECT doc_id, words, len(words)::BIGINT AS n FROM (SELECT doc_id, {WORDS} AS words FROM documents) WHERE len(words) > 0),
             s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM l),
             q AS (SELECT DISTINCT item_id, unnest({WORDS}) AS term FROM benchmark),
             t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(words) AS term FROM l) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
             f AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, docs),
             p AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))) AS part FROM t JOIN f USING (term), s),
             r AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY ALL HAVING sum(part) > 0)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r QUALIFY rank <= 50""",
    "op12_decontamination": f"""
        WITH i AS (SELECT item_id, words, least(10, len(words)) AS size FROM (SELECT item_id, {WORDS} AS words FROM benchmark) WHERE len(words) > 0),
             w AS (SELECT DISTINCT item_id, size, array_to_string(words[k + 1:k + size], ' ') AS span FROM (SELECT *, unnest(range(len(words) - size + 1)) AS k FROM i)),
             d AS (SELECT doc_id, coalesce({WORDS}, []) AS words FROM documents),
             g AS (SELECT doc_id, size, k, array_to_string(words[k + 1:k + size], ' ') AS span FROM (SELECT doc_id, words, size, unnest(range(len(words) - size + 1)) AS k FROM d, (SELECT DISTINCT size FROM w))),
             h AS (SELECT doc_id, item_id, size, k FROM g JOIN w USING (size, span)),
             n AS (SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM (SELECT doc_id, k, unnest(range(size)) AS o FROM h) GROUP BY 1),
             m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op7_source_mixing": mixing.oracle_sql(),
    "op4_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
             k AS (SELECT *, {LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
             c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
             f AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.top AS lost FROM k LEFT JOIN c ON k.key = c.key)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
        FROM f GROUP BY doc_id""",
}
