"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays that workers map.

Counting: each task counts the pairs (context, word) of its texts by 64-bit word hashes and sends one compressed block
for each shard of the pair's hash, so a very common pair or context is one entry for each task, and no context is
gathered in one place. A shard's blocks are merged into two arrays, sorted pair hashes and counts, in files of the
shared folder (counts of 32 bits, of 64 where one needs them); what words and contexts have in the shard goes on, again in blocks, to shards of the word's hash, whose
files hold each word's count, number of contexts and the totals of what follows it. Shards are ranges of the hash, so
the files in order are one sorted array. Only sums (tokens, words, counts of counts) come to the driver.

Scoring: a worker maps the files (from a shared local path as they are; from another store it fetches a file once and
unlinks it when mapped), looks up the distinct words and pairs of a slice of texts by binary search and sums.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, pieces, shared_folder

#: What stands for the end of a text (counted as a token) and for the place before its first word.
END, START = b"\n", np.uint64(0x5DEECE66D1CE4E5B)
#: Pairs that a task counts before it sends them.
HELD = 4_000_000


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(context) + word)


def tokenised(texts: list[bytes]):
    """Distinct words' hashes, each token's index among them, each token's context hash and the tokens of each text."""
    import pandas as pd
    import xxhash

    words, sizes = [], []
    for t in texts:
        own = t.lower().split()
        own.append(END)
        words += own
        sizes.append(len(own))
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(w) for w in distinct]), ">u8").astype(np.uint64)
    token = hashes[codes]
    context = np.r_[START, token[:-1]] if len(token) else token
    sizes = np.array(sizes, np.int64)
    context[np.cumsum(sizes) - sizes] = START
    return hashes, codes, token, context, sizes


def packed(*columns: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c, "<u8").tobytes() for c in columns))


def unpacked(blocks, n: int) -> list[np.ndarray]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(d.decompress(b), "<u8").reshape(n, -1) for b in blocks]
    return list(np.concatenate(parts, 1)) if parts else [np.empty(0, np.uint64)] * n


def summed(keys: np.ndarray, *values: np.ndarray):
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    return keys[starts], *[np.add.reduceat(v[order], starts) if len(starts) else v for v in values]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _blocks(keys: np.ndarray, shards: int, *columns: np.ndarray):
    """For sorted keys: (shard, packed columns) of each shard that has any."""
    if not len(keys):
        return
    s = shard_of(keys, shards)
    cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    for a, b in zip(cut, np.r_[cut[1:], len(s)]):
        yield int(s[a]), packed(*[c[a:b] for c in columns])


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "block"])


def _counted(batches, shards):
    held, n = [], 0

    def sent(held):
        pair, context, word, count = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(pair, kind="stable")
        pair, context, word, count = pair[order], context[order], word[order], count[order]
        at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        count = np.add.reduceat(count, at)
        pair, context, word = pair[at], context[at], word[at]
        s = shard_of(pair, shards)
        order = np.lexsort((context, s))  # runs of equal contexts pack well
        s, context, word, count = s[order], context[order], word[order], count[order]
        cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        return _batch([(int(s[a]), packed(context[a:b], word[a:b], count[a:b])) for a, b in zip(cut, np.r_[cut[1:], len(s)])])

    for batch in batches:
        for part in pieces(batch):
            _, _, word, context, _ = tokenised(arrow_bytes(part.column(0)))
            pair, at, count = np.unique(pair_hash(context, word), return_index=True, return_counts=True)
            held.append((pair, context[at], word[at], count.astype(np.uint64)))
            n += len(pair)
            if n > HELD:
                yield sent(held)
                held, n = [], 0
    if held:
        yield sent(held)


class Store:
    """Arrays in files of a folder that may be on any file system that pyarrow knows."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.local = isinstance(self.fs, fs.LocalFileSystem)

    def put(self, name: str, array: np.ndarray) -> None:
        """Under another name first: a task that runs twice leaves the same file."""
        self.fs.create_dir(self.path, recursive=True)
        own = f"{self.path}/.{name}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(own) as f:
            f.write(np.ascontiguousarray(array).tobytes())
        self.fs.move(own, f"{self.path}/{name}")

    def get(self, name: str, dtype) -> np.ndarray:
        from pyarrow import fs

        path = f"{self.path}/{name}"
        if self.local:
            return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
        with tempfile.NamedTemporaryFile() as f:
            fs.copy_files(path, f.name, source_filesystem=self.fs, destination_filesystem=fs.LocalFileSystem())
            return np.memmap(f.name, dtype, "r") if os.path.getsize(f.name) else np.empty(0, dtype)


def _merged_pairs(uri, shards):
    def merge(key, group):
        import pandas as pd

        shard = int(key[0])
        context, word, count = unpacked(group["block"], 3)
        pair = pair_hash(context, word)
        order = np.argsort(pair, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(pair[order]) != 0])
        pair, count = pair[order][at], np.add.reduceat(count[order], at)
        context, word = context[order][at], word[order][at]
        store = Store(uri)
        store.put(f"pairs-{shard}", pair)
        wide = len(count) > 0 and int(count.max()) >> 32 > 0
        store.put(f"counts{64 if wide else 32}-{shard}", count.astype(np.uint64 if wide else np.uint32))
        one = np.ones(len(pair), np.uint64)
        w, uses, contexts = summed(word, count, one)
        c, total, n1, n2, n3 = summed(context, count, *[(x).astype(np.uint64) for x in (count == 1, count == 2, count > 2)])
        zero_w, zero_c = np.zeros(len(w), np.uint64), np.zeros(len(c), np.uint64)
        keys, *values = summed(np.r_[w, c], np.r_[uses, zero_c], np.r_[contexts, zero_c], *[np.r_[zero_w, x] for x in (total, n1, n2, n3)])
        rows = list(_blocks(keys, shards, keys, *values))
        # Counts of counts of the pairs: at shard -1.
        rows.append((-1, packed(*[np.array([int((count == k).sum())]) for k in (1, 2, 3, 4)], np.array([len(pair)]), np.zeros(1), np.zeros(1))))
        return pd.DataFrame(rows, columns=["shard", "block"])

    return merge


def _merged_words(uri):
    def merge(key, group):
        import pandas as pd

        shard = int(key[0])
        columns = unpacked(group["block"], 7)
        if shard < 0:
            n = [int(c.sum()) for c in columns[:5]]
            return pd.DataFrame([("pairs", 0, 0, *n)], columns=SUMS)
        keys, uses, contexts, total, n1, n2, n3 = summed(*columns)
        store = Store(uri)
        store.put(f"words-{shard}", keys)
        store.put(f"stats-{shard}", np.stack([uses, contexts, total, n1, n2, n3], 1))
        own = contexts[contexts > 0]
        return pd.DataFrame([("words", int(uses.sum()), len(own), *[int((own == k).sum()) for k in (1, 2, 3, 4)], int(own.sum()))], columns=SUMS)

    return merge


SUMS = ["kind", "tokens", "words", "n1", "n2", "n3", "n4", "total"]


def discounts(n1, n2, n3, n4) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; where counts of counts are missing, half of Y."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y)
    return [min(max(d, 0.01), k - 0.01) for k, d in enumerate(raw, 1)]


def train(docs: DataFrame, text_col: str = "text") -> dict:
    """Counts all rows of docs. The model: the files' folder, the number of shards and a dozen sums."""
    spark = docs.sparkSession
    uri = f"{shared_folder(spark).rstrip('/')}/lm-{uuid.uuid4().hex}"
    rows = docs.select(docs[text_col].alias("text"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * rows.rdd.getNumPartitions())
    blocks = rows.mapInArrow(lambda b: _counted(b, shards), "shard int, block binary")
    parts = blocks.groupBy("shard").applyInPandas(_merged_pairs(uri, shards), "shard int, block binary")
    sums = parts.groupBy("shard").applyInPandas(_merged_words(uri), "kind string, tokens long, words long, n1 long, n2 long, n3 long, n4 long, total long")
    found = {r["kind"]: r for r in sums.groupBy("kind").agg(*[F.sum(c).alias(c) for c in SUMS[1:]]).collect()}
    word, pair = found.get("words"), found.get("pairs")
    if word is None:
        return {"uri": uri, "shards": 0, "tokens": 0, "words": 0, "types": 0, "d1": [0.5] * 3, "d2": [0.5] * 3, "floor": 1.0}
    d1, d2 = discounts(*[word[f"n{k}"] for k in (1, 2, 3, 4)]), discounts(*[pair[f"n{k}"] for k in (1, 2, 3, 4)])
    many = word["words"] - word["n1"] - word["n2"]
    left = (d1[0] * word["n1"] + d1[1] * word["n2"] + d1[2] * many) / word["total"]
    return {"uri": uri, "shards": shards, "tokens": word["tokens"], "words": word["words"], "types": word["total"], "d1": d1, "d2": d2, "floor": left / (word["words"] + 1)}


_open: dict = {}


def _files(model):
    if model["uri"] not in _open:
        _open.clear()
        store, names = Store(model["uri"]), None
        from pyarrow import fs

        names = {f.base_name for f in store.fs.get_file_info(fs.FileSelector(store.path))} if model["shards"] else set()
        opened = lambda a, b, t, k: (store.get(f"{a}-{k}", np.uint64), store.get(f"{b}-{k}", t)) if f"{b}-{k}" in names else None
        pairs = [opened("pairs", "counts32", np.uint32, k) or opened("pairs", "counts64", np.uint64, k) for k in range(model["shards"])]
        _open[model["uri"]] = pairs + [opened("words", "stats", np.uint64, k) for k in range(model["shards"])]
    files = _open[model["uri"]]
    return files[: model["shards"]], files[model["shards"] :]


def _looked_up(files, keys, width):
    """Values of sorted keys in sharded sorted arrays; 0 where a key is missing."""
    out = np.zeros((len(keys), width), np.int64)
    if not files or not len(keys):
        return out
    s = shard_of(keys, len(files)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    for a, b in zip(cut, np.r_[cut[1:], len(s)]):
        if files[s[a]] is not None:
            there, values = files[s[a]]
            at = np.minimum(np.searchsorted(there, keys[a:b]), len(there) - 1)
            hit = np.flatnonzero(there[at] == keys[a:b])
            out[a + hit] = values.reshape(-1, width)[at[hit]]
    return out


def score_texts(texts: list[bytes], model: dict):
    """For each text: tokens, known tokens, unigram base score and log10 probability under the model."""
    hashes, codes, token, context, sizes = tokenised(texts)
    if not len(sizes):
        return (np.empty(0),) * 4
    pairs, words = _files(model)
    d1, d2 = (np.array([0.0, *d]) for d in (model["d1"], model["d2"]))
    keys, back = np.unique(np.r_[hashes, START], return_inverse=True)
    stats = _looked_up(words, keys, 6)[back]
    uses, contexts = stats[:-1, 0], stats[:-1, 1]
    base = np.log10((uses + 0.5) / (model["tokens"] + 0.5 * (model["words"] + 1)))
    lower = np.maximum(contexts - d1[np.minimum(contexts, 3)], 0) / max(model["types"], 1) + model["floor"]
    total, n = stats[:, 2], stats[:, 3:6]
    left = np.where(total > 0, n @ d2[1:] / np.maximum(total, 1), 1.0)
    ends = np.cumsum(sizes)
    before = np.r_[len(hashes), codes[:-1]]
    before[ends - sizes] = len(hashes)
    pair, where = np.unique(pair_hash(context, token), return_inverse=True)
    count = _looked_up(pairs, pair, 1)[where, 0]
    p = (count - d2[np.minimum(count, 3)]) / np.maximum(total[before], 1) + left[before] * lower[codes]
    starts = ends - sizes
    return sizes, np.add.reduceat((uses > 0)[codes].astype(np.int64), starts), np.add.reduceat(base[codes], starts), np.add.reduceat(np.log10(p), starts)


def _scores(batches, model):
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, 4 << 20):
            n, known, base, score = score_texts(arrow_bytes(part.column(2)), model)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(part.num_rows, model["tokens"])), pa.array(base), pa.array(score)], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows whose remainder is not `held_out`. Null and empty texts are one end token; ids may
    repeat or be null (as empty text for the remainder); with no training rows every token is equally unlikely.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), (remainder(docs[id_col]) == held_out).alias("held_out"), docs[text_col].alias("text"))
    model = train(rows.where("not held_out"))
    return rows.mapInArrow(lambda b: _scores(b, model), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
