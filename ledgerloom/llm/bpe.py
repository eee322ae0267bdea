"""Byte-level BPE over length-bucketed padded numpy matrices.

Texts are split by the vocabulary's pattern; the distinct pieces of a slice of texts are encoded together. Pieces of
like length are rows of one matrix of byte tokens, padded with -1. In each round every row merges its leftmost pair of
the least rank; pair ranks come from an open-addressing hash table, and finished rows leave the matrix. Pieces of more
than LONG bytes (runs of one character class) have a matrix of their own that would need as many rounds as bytes; they
merge the same pairs in the same order from a heap.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_bytes, pieces

NONE = np.int64(1 << 40)
LONG = 160
#: Pieces whose encoding a worker remembers, in each of two generations.
REMEMBERED = 120_000


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Bpe:
    """Ranks from a file of lines `base64 rank`."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NONE, np.int64)
        slots, left = self._slot(keys), np.arange(len(keys))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        while len(left):
            free = left[self.slot_key[slots[left]] < 0]
            _, one = np.unique(slots[free], return_index=True)
            put = free[one]
            self.slot_key[slots[put]], self.slot_rank[slots[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            taken = left[self.slot_key[slots[left]] != keys[left]]
            slots[taken] = (slots[taken] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens; NONE where no token is the two together or one is padding."""
        shape, keys = a.shape, ((a << 32) | b).ravel()
        out, left = np.full(keys.shape, NONE), np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        slots = self._slot(keys[left])
        while len(left):
            there = self.slot_key[slots]
            hit = there == keys[left]
            out[left[hit]] = self.slot_rank[slots[hit]]
            on = ~hit & (there >= 0)
            left, slots = left[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)

    def _matrix(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of words that are alike in length."""
        size = np.array([len(w) for w in words])
        width = int(size.max())
        m = np.full((len(words), width + 1), -1, np.int64)
        m[np.arange(width + 1) < size[:, None]] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((len(words), width + 1), NONE)
        ranks[:, :-1] = self.pair_ranks(m[:, :-1], m[:, 1:])
        out, row = [None] * len(words), np.arange(len(words))
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(row)), at]
            over = best >= NONE
            if over.any():
                for k in np.flatnonzero(over):
                    out[row[k]] = m[k][m[k] >= 0]
                on = ~over
                m, ranks, row, at, best = m[on], ranks[on], row[on], at[on], best[on]
                if not len(row):
                    return out
                used = int((m >= 0).sum(1).max()) + 1
                m, ranks = m[:, :used], ranks[:, :used]
            n, cols = np.arange(len(row)), np.arange(m.shape[1] - 1)
            later = cols > at[:, None]
            m[:, :-1] = np.where(later, m[:, 1:], m[:, :-1])
            ranks[:, :-1] = np.where(later, ranks[:, 1:], ranks[:, :-1])
            m[:, -1], ranks[:, -1] = -1, NONE
            m[n, at] = best
            ranks[n, at] = self.pair_ranks(best, m[n, np.minimum(at + 1, m.shape[1] - 1)])
            before = at > 0
            ranks[n[before], at[before] - 1] = self.pair_ranks(m[n[before], at[before] - 1], best[before])

    def _heap(self, word: bytes) -> np.ndarray:
        """The same merges in the same order for one long word, in n log n steps."""
        ids, n = self.byte[np.frombuffer(word, np.uint8)].tolist(), len(word)
        after, before, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := pairs.get(rank << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := pairs.get(ids[before[i]] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, before[i]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word (no empty ones)."""
        out, buckets = [None] * len(words), {}
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self._heap(w)
            else:
                buckets.setdefault(len(w) if len(w) < 16 else -(-len(w) // 8) * 8, []).append(k)
        for own in buckets.values():
            for i in range(0, len(own), 1 << 14):
                part = own[i : i + (1 << 14)]
                for k, ids in zip(part, self._matrix([words[k] for k in part])):
                    out[k] = ids
        return out


@lru_cache(2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(2)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


class Encoder:
    """Remembers (ids as text, number of ids, decoded bytes) of the pieces seen of late."""

    def __init__(self, path: str, pattern: str):
        self.bpe, self.split = bpe(path), _pattern(pattern).findall
        self.new, self.old = {}, {}

    def texts(self, texts: list[str]):
        """For each text: its ids joined by commas, their number and the bytes that they decode to."""
        split = [self.split(t) for t in texts]
        if len(self.new) > REMEMBERED:
            self.new, self.old = {}, self.new
        new, old, missing = self.new, self.old, {}
        for own in split:
            for p in own:
                if p not in new:
                    if p in old:
                        new[p] = old[p]
                    else:
                        missing[p] = None
        words, tokens = list(missing), self.bpe.tokens
        for word, ids in zip(words, self.bpe.encode_words([w.encode() for w in words])):
            ids = ids.tolist()
            new[word] = (",".join(map(str, ids)), len(ids), b"".join([tokens[i] for i in ids]))
        for own in split:
            found = [new[p] for p in own]
            yield ",".join([x[0] for x in found]), sum([x[1] for x in found]), b"".join([x[2] for x in found])


@lru_cache(1)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _round_trip(batches, path, pattern):
    import hashlib

    import pyarrow as pa

    encoder = _encoder(path, pattern)
    for batch in batches:
        for part in pieces(batch, 2 << 20):
            found = [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()) for ids, n, raw in encoder.texts([x.decode("utf-8", "replace") for x in arrow_bytes(part.column(1))])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encoded(batches, path, pattern):
    import pyarrow as pa

    encoder = _encoder(path, pattern)
    for batch in batches:
        for part in pieces(batch, 2 << 20):
            ids = [np.array(x.split(","), np.int32) if x else np.empty(0, np.int32) for x, _, _ in encoder.texts([x.decode("utf-8", "replace") for x in arrow_bytes(part.column(1))])]
            ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))], ["id", "ids"])


def _decoded(batches, path):
    import pyarrow as pa

    tokens = bpe(path).tokens
    for batch in batches:
        texts = [b"".join([tokens[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])


def _defaults(path, pattern):
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return path or vocabulary_path(), pattern


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row, in place: no shuffle. Null and empty texts have no ids; ids may repeat or be null."""
    path, pattern = _defaults(path, pattern)
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(lambda b: _encoded(b, path, pattern), "id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(id, text) of rows (id, ids); null ids decode to the empty text, bytes that are no UTF-8 to U+FFFD."""
    path, _ = _defaults(path, "")
    return encoded.select("id", "ids").mapInArrow(lambda b: _decoded(b, path), "id long, text string")


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row; see bpe_encode for nulls and repeats."""
    path, pattern = _defaults(path, pattern)
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(lambda b: _round_trip(b, path, pattern), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
