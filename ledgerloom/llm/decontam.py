"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of a benchmark item (the whole item where it has fewer). Of every WINDOW words in a
row, documents and items both keep the least of its hashed GRAM-word grams (the last of equal ones): a fingerprint. A
span of WINDOW words that two texts share holds the same grams at the same places, so both keep the same one of it, and
none is missed. Items of fewer words are one gram of all their words; documents are asked for all grams of the lengths
that occur (fewer than WINDOW), which is winnowing with windows of one gram.

Fingerprints of the documents are joined with those of the items. What meets is extended: from the words around the
fingerprint, its windows are joined with the items' windows by their words, so a hash decides nothing.

A document's fingerprints are not all shuffled: a bit map of fixed size of the items' fingerprints goes to the workers,
and only those whose bit is set leave the task. A full map only costs that gain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAP_BITS, keyed, shown_id, written
from .words import Words, grams, text_slices

WINDOW, GRAM = 10, 5
#: Parts into which each key of the joins is dealt, so that one passage of very many documents is no single task.
SALTS = 16
_BASE = "id long, digest long, n_words long, size int, hash long, at long, lead int, words string"


def winnowed(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of the words at which a kept gram starts. hashes: of the grams of GRAM words; text: each word's text."""
    span = WINDOW - GRAM + 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = hashes[:n].copy()
    for j in range(1, span):
        np.minimum(low, hashes[j : j + n], out=low)
    at = np.zeros(n, np.int64)
    for j in range(1, span):
        at[hashes[j : j + n] == low] = j
    at += np.arange(n)
    return np.unique(at[text[:n] == text[WINDOW - 1 : WINDOW - 1 + n]])


def _items(batches):
    """(item, size, hash or null, words or null): fingerprints of an item, and its windows by their words."""
    import pyarrow as pa

    for part, w in text_slices(batches):
        ids, out, hashed = part.column(0).to_pylist(), [], w.hashes()
        kept = winnowed(grams(hashed, GRAM), w.text)
        five = grams(hashed, GRAM)
        out += [(ids[t], WINDOW, h, None) for t, h in zip(w.text[kept].tolist(), five[kept].view(np.int64).tolist())]
        for t in range(w.n_texts):
            a, b = int(w.first[t]), int(w.first[t + 1])
            if 0 < b - a < WINDOW:
                out.append((ids[t], b - a, int(grams(hashed[a:b], b - a).view(np.int64)[0]), None))
            size = min(WINDOW, b - a)
            out += [(ids[t], size, None, w.joined(i, i + size).decode("utf-8", "replace")) for i in range(a, b - size + 1) if size]
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.string()))], ["item", "size", "hash", "words"])


def _documents(batches, bits, sizes):
    """A row for each text (size 0) and one for each of its fingerprints whose bit is set, with the words around it."""
    import pyarrow as pa
    import xxhash

    table = np.frombuffer(bits.value, np.uint8)
    for part, w in text_slices(batches):
        ids = part.column(0).to_numpy(zero_copy_only=False)
        edges = np.r_[0, w.ends].tolist()
        digest = np.array([xxhash.xxh3_64_intdigest(w.data[a:b]) for a, b in zip(edges, edges[1:])], np.uint64).view(np.int64)
        hashed, n = w.hashes(), np.diff(w.first)
        out = [(0, np.zeros(w.n_texts, np.int64), np.zeros(w.n_texts, np.int64), np.arange(w.n_texts), np.zeros(w.n_texts, np.int32), [""] * w.n_texts)]
        for size in sizes:
            five = grams(hashed, min(size, GRAM) if size == WINDOW else size)
            if size == WINDOW:
                at = winnowed(five, w.text)
            else:
                at = np.flatnonzero(w.text[: len(five)] == w.text[size - 1 : size - 1 + len(five)]) if len(five) else np.empty(0, np.int64)
            h = five[at]
            bit = (h & np.uint64(8 * len(table) - 1)).astype(np.int64)
            hit = (table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            at, h = at[hit], h[hit].view(np.int64)
            text = w.text[at]
            low, high = (np.maximum(at - (WINDOW - GRAM), w.first[text]), np.minimum(at + WINDOW, w.first[text + 1])) if size == WINDOW else (at, at + size)
            around = [w.joined(a, b).decode("utf-8", "replace") for a, b in zip(low.tolist(), high.tolist())]
            out.append((size, h, low - w.first[text], text, (at - low).astype(np.int32), around))
        for size, h, at, text, lead, around in out:
            yield pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array(digest[text]), pa.array(n[text]), pa.array(np.full(len(text), size, np.int32)), pa.array(h), pa.array(at), pa.array(lead), pa.array(around, pa.string())], ["id", "digest", "n_words", "size", "hash", "at", "lead", "words"])


def _bit_map(prints: DataFrame) -> bytes:
    """One bit for each fingerprint, MAP_BITS in all: MAP_BITS / 32,768 rows come to the driver, whatever the input."""
    bit = F.pmod(F.col("hash"), F.lit(MAP_BITS)) + 1  # Spark's buckets hold numbers from 1 on
    rows = prints.select(bit.alias("bit")).groupBy(F.call_function("bitmap_bucket_number", F.col("bit")).alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("map")).collect()
    found, width = bytearray(MAP_BITS // 8), (1 << 15) // 8
    for r in rows:
        found[(r["bucket"] - 1) * width : r["bucket"] * width] = r["map"]
    return bytes(found)


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))


def contaminated_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts has (id, digest, n_words) of every row of docs; spans has (id, digest, at, size, item), each
    once: the item's window of `size` words lies at the document's words from `at` on.

    Null texts have no words; items without a word have no window; a null item id is the empty one, and rows that repeat
    an item id are one item with the windows of all. Rows of docs that repeat id and text have the same spans, told once;
    a null id is NULL_ID. Empty tables give empty ones; other columns are not looked at; long texts are one row each.
    """
    spark = docs.sparkSession
    known = items.select(F.coalesce(items[item_col].cast("string"), F.lit("")).alias("item"), items[item_text].alias("text")).mapInArrow(_items, "item string, size int, hash long, words string")
    known = written(known.distinct(), "windows")
    prints = written(known.where("hash IS NOT NULL").select("size", "hash").distinct(), "prints")
    sizes = sorted(r["size"] for r in prints.select("size").distinct().collect())  # at most WINDOW numbers
    bits = spark.sparkContext.broadcast(_bit_map(prints))
    rows = written(keyed(docs, id_col, text_col, "text").mapInArrow(lambda b: _documents(b, bits, sizes), _BASE), "fingerprints")
    texts = rows.where("size = 0").select("id", "digest", "n_words")
    hits = rows.where("size > 0").withColumn("salt", F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int")).join(_salted(prints), ["salt", "size", "hash"])
    # A fingerprint's windows start at most WINDOW - GRAM words before it, which is where its words begin, and not after it.
    around = F.split("words", " ")
    starts = F.when(F.size(around) >= F.col("size"), F.sequence(F.lit(0), F.least(F.col("lead"), F.size(around) - F.col("size")))).otherwise(F.array().cast("array<int>"))
    near = hits.select("id", "digest", "at", "size", around.alias("around"), F.explode(starts).alias("k"))
    near = near.select("id", "digest", (F.col("at") + F.col("k")).alias("at"), "size", F.array_join(F.slice("around", F.col("k") + 1, F.col("size")), " ").alias("words")).distinct()
    windows = known.where("words IS NOT NULL").select("size", "words", "item").distinct()
    spans = near.withColumn("salt", F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int")).join(_salted(windows), ["salt", "size", "words"])
    return texts, spans.select("id", "digest", "at", "size", "item")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit (words within any window), items (sorted ids of the items that have
    a window in it), contaminated. See contaminated_spans for odd rows."""
    texts, spans = contaminated_spans(docs, items, id_col, text_col, item_col, item_text)
    spans = written(spans, "spans")
    key = ["id", "digest"]
    before = Window.partitionBy(*key).orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    reach = spans.select(*key, "at", "size").distinct().withColumn("end", F.col("at") + F.col("size"))
    reach = reach.withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0).cast("long")))
    hit = reach.groupBy(*key).agg(F.sum(F.greatest(F.lit(0).cast("long"), F.col("end") - F.greatest("at", "seen"))).alias("n_hit"))
    found = spans.select(*key, "item").distinct().groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    rows = texts.join(hit.join(found, key), key, "left")
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(shown_id().alias("id"), "n_words", n.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n > 0).alias("contaminated"))
