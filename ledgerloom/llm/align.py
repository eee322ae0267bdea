"""Alignment of two tokenizers' tokens over the same bytes, with the links' counts over all documents.

Both tokenisations of a text cut the same bytes. Places where tokens of both end cut them into groups; two tokens whose
bytes overlap are linked. Nearly all groups are one token on either side with the same bytes, and for those a table made
once says which id of B has the bytes of an id of A: such links (wherever they occur) are counted in one vector of the
vocabulary's length a task. Only other pairs go into the shuffle that counts pairs, each task's sums first.

Counts come back to the documents in a second pass over the written alignments: the vectors (counts of the table's links,
highest count of each A id) are as long as the vocabulary; of the other pairs the HEAD most frequent or fewer go to the
workers as sorted arrays, and a document's remaining pairs are joined with the counted ones. The head only saves shuffle:
what it does not hold is joined, whatever its size.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, pieces, shown_id, written

#: Irregular pairs whose counts go to the workers: 16 bytes each.
HEAD = 1 << 20
#: Bytes of text that are aligned together.
SLICE = 1 << 20
#: Runs without a break that are left to the slower library, which takes n log n steps for them.
LONG_RUN = re.compile(r"\S{1000}|\s{1000}")
_ALIGNED = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself where it is printable, else the next from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """Tokenizer A: a byte-level BPE of the tokenizers library's JSON format; `tokens` are the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocabulary = byte_alphabet(), spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", ())}
        self.tokens = [b""] * (1 + max(*vocabulary.values(), *(t["id"] for t in spec.get("added_tokens", ()))))
        for token, i in vocabulary.items():
            self.tokens[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        self.fast = self._fast(spec, vocabulary, special)

    def _fast(self, spec, vocabulary, special):
        """The same merges by the tiktoken library, where ids grow with the merges' order and the splitting is its own."""
        import public_tokenizers
        import tiktoken

        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [vocabulary["".join(m)] for m in merges]
        before = spec.get("pre_tokenizer") or {}
        same = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
        if not same or ids != sorted(set(ids)) or spec["model"].get("ignore_merges"):
            return None
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={self.tokens[i]: i for t, i in vocabulary.items() if t not in special}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = [None if self.fast is None or LONG_RUN.search(t) else self.fast.encode_ordinary(t) for t in texts]
        left = [k for k, ids in enumerate(out) if ids is None]
        for k, found in zip(left, self.slow.encode_batch([texts[k] for k in left], add_special_tokens=False) if left else ()):
            out[k] = found.ids
        return out


class PieceTokens:
    """Tokenizer B: a sentencepiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Pair:
    """Both tokenizers, and for each id of A the id of B with the same bytes (-1: none)."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        by_bytes: dict[bytes, int] = {}
        for i, t in enumerate(self.b.tokens):
            by_bytes.setdefault(t, i)
        self.same = np.array([by_bytes.get(t, -1) if t else -1 for t in self.a.tokens], np.int64)
        self.size_a, self.size_b = (np.array([len(t) for t in x.tokens], np.int64) for x in (self.a, self.b))
        self.join_a, self.join_b = np.array(self.a.tokens, object), np.array(self.b.tokens, object)
        # How an id is written, with what follows it inside its side, and at the side's end.
        self.shown = np.array([f"{i},".encode() for i in range(len(self.size_a))] + [f"{i}|".encode() for i in range(len(self.size_a))] + [f"{i},".encode() for i in range(len(self.size_b))] + [f"{i};".encode() for i in range(len(self.size_b))])


@lru_cache(2)
def tokenizers(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def aligned(pair: Pair, ids_a: list[list[int]], ids_b: list[list[int]]):
    """For texts whose tokens cover the same bytes: ends of A's and B's tokens by text, then over all texts together
    n_groups, n_links, the groups' texts, and the links (text, a, b)."""
    n_a, n_b = (np.array([len(x) for x in y], np.int64) for y in (ids_a, ids_b))
    a, b = (np.concatenate([np.asarray(x, np.int64) for x in y]) if y else np.empty(0, np.int64) for y in (ids_a, ids_b))
    text = np.repeat(np.arange(len(ids_a)), n_a)
    end_a, end_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
    at = np.searchsorted(end_b, end_a)
    cut_a = end_b[np.minimum(at, len(end_b) - 1)] == end_a if len(end_b) else np.zeros(0, bool)
    cut_b = np.zeros(len(end_b), bool)
    cut_b[at[cut_a]] = True
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    groups = np.bincount(text[cut_a], minlength=len(ids_a))
    # Where each token stands among all, groups in order and A before B in each.
    in_a, in_b = np.bincount(group_a), np.bincount(group_b)
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = a + cut_a * len(pair.size_a)
    order[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = b + cut_b * len(pair.size_b) + 2 * len(pair.size_a)
    written_out, stops = pair.shown[order], np.cumsum(n_a + n_b)
    shown = [written_out[s:e].tobytes().replace(b"\0", b"")[:-1] for s, e in zip(np.r_[0, stops].tolist(), stops.tolist())]
    begin = end_a - pair.size_a[a]
    low, high = np.searchsorted(end_b, begin, "right"), at
    times = high - low + 1
    of_a = np.repeat(np.arange(len(a)), times)
    of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(times) - times, times) + low[of_a]
    links = np.bincount(text[of_a], minlength=len(ids_a))
    return n_a, n_b, groups, links, shown, text[of_a], a[of_a], b[of_b]


def _aligned(batches, paths):
    """Rows of _ALIGNED: pairs are a * (ids of B) + b, distinct and sorted, with how often the text links them."""
    import hashlib

    import pyarrow as pa

    pair = tokenizers(*paths)
    for batch in batches:
        for part in pieces(batch, SLICE):
            texts = [t or "" for t in part.column(2).to_pylist()]
            full = [" " + t for t in texts]
            ids_a, ids_b = pair.a.encode(full), pair.b.encode(texts)
            for k, t in enumerate(texts):
                raw = full[k].encode()
                if not t or b"".join(pair.join_a[ids_a[k]]) != raw or b"".join(pair.join_b[ids_b[k]]) != raw:
                    ids_a[k], ids_b[k] = [], []
            n_a, n_b, groups, links, shown, text, a, b = aligned(pair, ids_a, ids_b)
            size = len(pair.size_a) * len(pair.size_b)
            keys, times = np.unique(text * size + a * len(pair.size_b) + b, return_counts=True)
            ends = np.searchsorted(keys, np.arange(part.num_rows + 1) * size).astype(np.int32)
            digest = [hashlib.sha256(x).hexdigest() if x else "" for x in shown]
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (keys % size, times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, (n_a, n_b, groups, links)), pa.array(digest, pa.string()), *lists], ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


class Sums:
    """Sums of sorted keys that come in slices, merged when they have grown to LIMIT."""

    LIMIT = 1 << 21

    def __init__(self):
        self.keys, self.held, self.n = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0

    def add(self, keys: np.ndarray):
        self.held.append(keys)
        self.n += len(keys)
        if self.n > self.LIMIT:
            self.merge()

    def merge(self):
        found, n = np.unique(np.concatenate([np.empty(0, np.int64), *self.held]), return_counts=True)
        keys, at = np.unique(np.r_[self.keys[0], found], return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, np.r_[self.keys[1], n])
        self.keys, self.held, self.n = (keys, total), [], 0


def _counted(batches, same, width):
    """(pair, documents): links of the table from a vector, other pairs from the task's own sums, let go when they are many."""
    import pyarrow as pa

    regular, other = np.zeros(len(same), np.int64), Sums()

    def rows(keys, n):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "documents"])

    for batch in batches:
        keys = batch.column(0).flatten().to_numpy()
        one = same[keys // width] == keys % width
        regular += np.bincount(keys[one] // width, minlength=len(same))
        other.add(keys[~one])
        if len(other.keys[0]) > Sums.LIMIT:
            yield rows(*other.keys)
            other = Sums()
    other.merge()
    yield rows(*other.keys)
    there = np.flatnonzero(regular)
    yield rows(there * width + same[there], regular[there])


def _scored(batches, known, width):
    """(row, pair, times, n_best, count_sum): a row for each document (pair -1), and one for each pair that is not known."""
    import pyarrow as pa

    same, regular, best, head, count = known.value
    for batch in batches:
        for part in pieces(batch, 4 << 20):
            rows, lists = part.column(0).to_numpy(), part.column(1)
            text = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
            keys, times = lists.flatten().to_numpy(), part.column(2).flatten().to_numpy().astype(np.int64)
            a = keys // width
            one = same[a] == keys % width
            n = np.where(one, regular[a], 0)
            at = np.minimum(np.searchsorted(head, keys), max(0, len(head) - 1))
            there = ~one & (head[at] == keys) if len(head) else np.zeros(len(keys), bool)
            n[there] = count[at[there]]
            yes, left = one | there, ~(one | there)
            total, top = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            np.add.at(total, text[yes], (n * times)[yes])
            is_best = yes & (n == best[a])
            np.add.at(top, text[is_best], times[is_best])
            none = np.zeros(int(left.sum()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[x, y]) for x, y in ((rows, rows[text[left]]), (np.full(len(rows), -1), keys[left]), (np.zeros(len(rows), np.int64), times[left]), (top, none), (total, none))], ["row", "pair", "times", "n_best", "count_sum"])


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def token_alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, head: int = HEAD) -> DataFrame:
    """For each row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null, empty, or that either tokenizer does not give back byte by byte have no tokens: zeros and an
    empty digest. Each row is a document, also where it repeats an id or a text; a null id stays null; no rows give no
    rows; other columns are not looked at. A very long text is aligned as a whole, in memory of some 100 bytes for each of
    its tokens. Pair counts that tie for an A id's highest all count as best.
    """
    spark, paths = docs.sparkSession, paths or tokenizer_paths()
    pair = tokenizers(*paths)
    same, width = pair.same, len(pair.size_b)
    rows = keyed(docs, id_col, text_col, "text").select(F.monotonically_increasing_id().alias("row"), "id", "text")
    found = written(rows.mapInArrow(lambda b: _aligned(b, paths), _ALIGNED), "alignments")
    counts = found.select("pairs").mapInArrow(lambda b: _counted(b, same, width), "pair long, documents long")
    counts = written(counts.groupBy("pair").agg(F.sum("documents").alias("documents")), "pairs")
    tops = spark.sparkContext.broadcast(_known(counts, same, width, head))
    parts = written(found.select("row", "pairs", "times").mapInArrow(lambda b: _scored(b, tops, width), "row long, pair long, times long, n_best long, count_sum long"), "scored")
    best = spark.createDataFrame([(i, n) for i, n in enumerate(tops.value[2].tolist()) if n], "a long, best long")
    left = parts.where("pair >= 0").join(counts, "pair").withColumn("a", F.floor(F.col("pair") / width)).join(F.broadcast(best), "a")
    left = left.groupBy("row").agg(F.sum(F.when(F.col("documents") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("documents") * F.col("times")).alias("more_sum"))
    sums = parts.where("pair < 0").select("row", "n_best", "count_sum").join(left, "row", "left").select("row", *[(F.col(c) + F.coalesce(m, F.lit(0).cast("long"))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))])
    return found.join(sums, "row").select(shown_id().alias("id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _known(counts: DataFrame, same: np.ndarray, width: int, head: int):
    """(table, its links' counts, each A id's highest count, most frequent other pairs, their counts), for the workers.

    The driver sees one row for each A id, at most 64 rows of sizes and at most `head` rows of pairs.
    """
    a, b = F.floor(F.col("pair") / width), F.col("pair") % width
    table = counts.sparkSession.createDataFrame([(i, int(j)) for i, j in enumerate(same.tolist()) if j >= 0], "a long, same long")
    rows = counts.withColumns({"a": a, "b": b}).join(F.broadcast(table), "a", "left").withColumn("one", F.coalesce(F.col("b") == F.col("same"), F.lit(False)))
    best, regular = (np.zeros(len(same), np.int64) for _ in range(2))
    for r in rows.groupBy("a").agg(F.max("documents").alias("best"), F.max(F.when(F.col("one"), F.col("documents"))).alias("own")).collect():
        best[r["a"]], regular[r["a"]] = r["best"], r["own"] or 0
    other = rows.where("NOT one")
    sizes = {r["bits"]: r["n"] for r in other.groupBy(F.length(F.bin("documents")).alias("bits")).agg(F.count("*").alias("n")).collect()}
    least, held = 65, 0
    while least > 1 and held + sizes.get(least - 1, 0) <= head:
        least, held = least - 1, held + sizes.get(least - 1, 0)
    top = other.where(F.length(F.bin("documents")) >= least).select("pair", "documents").toArrow()
    key, n = (top.column(c).to_numpy().astype(np.int64) for c in ("pair", "documents"))
    order = np.argsort(key)
    return same, regular, best, key[order], n[order]
