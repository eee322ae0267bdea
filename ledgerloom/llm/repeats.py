"""Removal of repeated passages: every byte under a string of `length` bytes that starts anywhere else too.

Bucket-pointer refinement over suffixes that are compared to `length` bytes only:

* Initial buckets: the q-gram of GRAM bytes at most at a position.
* Refinement: the bucket of a longer string is that of its first half together with the bucket at the later offset where
  its second half starts; each level reuses the identifiers that the level below has given, up to `length` bytes. An
  identifier is a 64-bit hash that is equal wherever the bytes are equal, so those of a level need no shuffle.
* Of the strings of half the length that start in a window of `length` bytes, the least by hash (the leftmost of equals) is the
  window's anchor: equal windows have equal anchors at equal offsets, and about one position in length / 4 is an anchor.
  Only anchors are sorted across documents, each with the windows that it stands for, by the anchor's bucket and, within
  it, by the identifiers at the later offsets, those of the first and the last window (which cover all the bytes).
  Members that still share a bucket repeat each other in all these windows and are done.
* The remaining members of buckets with several parts (the ends of passages, near copies) are refined once more, window
  by window, by the window's own identifier.

A window is identified by its anchor's bucket and its own, 128 bits together. What is met twice in a slice of texts is
settled there, anchors and windows alike, and sent on once, so a very common passage is a row for each slice.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_bytes, keyed, pieces, written

LENGTH = 400
#: Window starts that are handled at once.
CHUNK = 1 << 17
#: Kinds of window rows: one that only stands for others, one that waits for a partner, one that has been met.
SHOWN, SINGLE, SETTLED = 0, 1, 2
ROOT = 0x9E3779B97F4A7C15 | 1
#: Longest initial q-gram; bytes of windows that are refined in one go.
GRAM, STRETCH = 32, 1 << 21


@lru_cache(1)
def _tables():
    byte = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
    n = 4 * CHUNK + STRETCH
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, ROOT, np.uint64)])
        back = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(ROOT, -1, 1 << 64), np.uint64)])
    return byte, power, back


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def identifiers(raw: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifiers of the strings of `length` bytes at every position, from those of half the length."""
    n = max(0, len(raw) - length + 1)
    if length <= GRAM:
        byte, power, back = _tables()
        sums = np.r_[np.uint64(0), np.cumsum(byte[raw] * power[: len(raw)])]
        return _mixed((sums[length : length + n] - sums[:n]) * back[:n])
    half = -(-length // 2)
    below = identifiers(raw, half)
    return _refined(below[:n], below[length - half : length - half + n])


def _refined(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    x = first * np.uint64(ROOT) + later
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def anchors(text: bytes, length: int):
    """For each anchor: its bucket, the identifier of all bytes under its windows, the first window, their number, the anchor's place."""
    half, found = -(-length // 2), []
    raw = np.frombuffer(text, np.uint8)
    w = length - half + 1
    for c in range(0, len(raw) - length + 1, CHUNK):
        m = min(CHUNK, len(raw) - length + 1 - c)
        grams = identifiers(raw[c : c + m + length - 1], half)
        n = len(grams)
        whole = _refined(grams[:m], grams[w - 1 : w - 1 + m])
        packed = np.full(-(-n // w) * w, ~np.uint64(0))
        packed[:n] = (grams & ~np.uint64(0x3FFFF)) | np.arange(n, dtype=np.uint64)
        rows = packed.reshape(-1, w)
        before, after = np.minimum.accumulate(rows, 1).ravel(), np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        at = (np.minimum(after[:m], before[w - 1 : w - 1 + m]) & np.uint64(0x3FFFF)).astype(np.int64)
        cut = np.flatnonzero(at[1:] != at[:-1]) + 1
        lo, hi = np.r_[0, cut], np.r_[cut, m]
        place = at[lo] - lo
        under = _mixed(_refined(_mixed(whole[lo]), whole[hi - 1]) + _mixed((place << 20 | (hi - lo)).astype(np.uint64)))
        found.append((grams[at[lo]], under, lo + c, hi - lo, place))
    return found


def windows(stretches: list[bytes], length: int) -> list[np.ndarray]:
    """Identifiers of the windows of each stretch of bytes, many stretches at once."""
    out, at = [], 0
    while at < len(stretches):
        size = np.cumsum([len(x) for x in stretches[at : at + 4096]])
        n = max(1, int(np.searchsorted(size, STRETCH, "right")))
        found, start = identifiers(np.frombuffer(b"".join(stretches[at : at + n]), np.uint8), length), 0
        for x in stretches[at : at + n]:
            out.append(found[start : start + len(x) - length + 1])
            start += len(x)
        at += n
    return out


def _twice(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a double by (a, b), and which are the first of their kind."""
    _, at, back, many = np.unique(_mixed(a) + b, return_index=True, return_inverse=True, return_counts=True)
    first = np.zeros(len(a), bool)
    first[at] = True
    return many[back] > 1, first


def _anchor_rows(batches, length):
    """Anchors to match elsewhere; of those met twice in a slice, one that only shows, and all of them as settled."""
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch):
            ids, own = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            out = []
            for k, text in enumerate(arrow_bytes(part.column(1))):
                out += [(*x, np.full(len(x[0]), ids[k]), np.full(len(x[0]), own[k])) for x in anchors(text, length)]
            if not out:
                continue
            a, e, lo, n, place, i, o = (np.concatenate(x) for x in zip(*out))
            twice, first = _twice(a, e)
            sent = ~twice | first
            kind = np.r_[np.where(twice[sent], SHOWN, SINGLE).astype(np.int8), np.full(twice.sum(), SETTLED, np.int8)]
            # Settled rows need no partner: keys of their own spread them.
            apart = _mixed(_mixed(o[twice].view(np.uint64) + i[twice].view(np.uint64)) + lo[twice].astype(np.uint64))
            a, e = np.r_[a[sent], apart], np.r_[e[sent], apart]
            i, o, lo, n, place = (np.r_[c[sent], c[twice]] for c in (i, o, lo, n, place))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(e.view(np.int64)), pa.array(i), pa.array(o), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(kind)], ["a", "e", "id", "own", "lo", "n", "place", "kind"])


def _window_rows(batches, length):
    """Rows (text, id, own, todo) -> windows to match elsewhere; of those met twice in a slice, one that only shows, and those that asked as settled."""
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, 4 << 20):
            out, stretches = [], []
            for text, i, o, todo in zip(opened(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                for x in todo:
                    n = x["n"]
                    stretches.append(text[x["lo"] : x["lo"] + n + length - 1])
                    out.append((np.full(n, x["a"]), np.arange(x["place"], x["place"] - n, -1), np.full(n, i), np.full(n, o), np.arange(x["lo"], x["lo"] + n, dtype=np.int32), np.full(n, x["single"])))
            if not out:
                continue
            a, place, i, o, lo, single = (np.concatenate(x) for x in zip(*out))
            h = _mixed(np.concatenate(windows(stretches, length)) + place.astype(np.uint64)).view(np.int64)
            twice, first = _twice(a.view(np.uint64), h.view(np.uint64))
            settled, sent = single & twice, ~twice | first
            kind = np.r_[(single & ~twice)[sent].astype(np.int8), np.full(settled.sum(), SETTLED, np.int8)]
            # Settled rows need no partner: a key of their own (text, place) spreads them.
            a, h = np.r_[a[sent], o[settled]], np.r_[h[sent], lo[settled]]
            i, o, lo = (np.r_[c[sent], c[settled]] for c in (i, o, lo))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a, h, i, o, lo, kind)], ["a", "h", "id", "own", "lo", "kind"])


def _closed(batches):
    """The first column, a text, compressed: texts are shuffled, and whole texts pack better than Spark's small blocks."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for part in pieces(batch):
            yield pa.RecordBatch.from_arrays([pa.array([pack(x) for x in arrow_bytes(part.column(0))], pa.binary()), *part.columns[1:]], ["packed", "id", "own"])


def opened(column) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in column.to_pylist()]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed(docs, id_col, text_col, "text").select("text", "id", F.xxhash64("text").alias("own"))


def packed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _texts(docs, id_col, text_col).mapInArrow(_closed, "packed binary, id long, own long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, own, spans array<struct<lo, hi>>): byte ranges under repeated strings, for each row that has any.

    own is a hash of the text, so rows that repeat an id are told apart; a row that occurs twice repeats itself. Null
    and empty texts and those of fewer than `length` bytes have no span. Ranges may overlap and are in no order.
    """
    found = _texts(docs, id_col, text_col).select("id", "text", "own").mapInArrow(lambda b: _anchor_rows(b, length), "a long, e long, id long, own long, lo int, n int, place int, kind byte")
    # One shuffle on the bucket serves all three; a bucket's rows stream and spill, none is held in memory.
    bucket, part = Window.partitionBy("a"), Window.partitionBy("a", "e")
    met = found.withColumns({"members": F.count("*").over(part), "nth": F.row_number().over(part.orderBy("id", "own", "lo")), "all": F.count("*").over(bucket)}).where(f"all > 1 OR kind = {SETTLED}")
    met = written(met, "anchors")
    # Rows that only show have a settled row besides.
    done = met.where(f"kind = {SETTLED} OR (kind = {SINGLE} AND members > 1)").select("id", "own", "lo", (F.col("lo") + F.col("n") - 1 + length).alias("hi"))
    todo = met.where(f"kind <> {SETTLED} AND `all` > members AND nth = 1").groupBy("id", "own").agg(F.collect_list(F.struct("a", "lo", "n", "place", F.expr(f"members = 1 AND kind = {SINGLE}").alias("single"))).alias("todo"))
    finer = packed_texts(docs, id_col, text_col).join(todo, ["id", "own"]).select("packed", "id", "own", "todo").mapInArrow(lambda b: _window_rows(b, length), "a long, h long, id long, own long, lo int, kind byte")
    finer = finer.withColumn("many", F.count("*").over(Window.partitionBy("a", "h")))
    more = finer.where(f"kind = {SETTLED} OR (kind = {SINGLE} AND many > 1)").select("id", "own", "lo", (F.col("lo") + length).alias("hi"))
    return done.union(more).groupBy("id", "own").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def remaining(text: bytes, spans) -> tuple[bytes, int, int]:
    """The text without its spans, bytes removed and maximal removed runs."""
    if not spans:
        return text, 0, 0
    step = np.zeros(len(text) + 2, np.int64)
    np.add.at(step, [x["lo"] + 1 for x in spans], 1)
    np.add.at(step, [x["hi"] + 1 for x in spans], -1)
    gone = np.cumsum(step)[1:-1] > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(np.int8)]) > 0).sum())


def _digests(batches):
    import hashlib

    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, 4 << 20):
            texts = opened(part.column(1))
            found = [remaining(t, s) for t, s in zip(texts, part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in found], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs."""
    spans = repeated_spans(docs, id_col, text_col, length)
    rows = packed_texts(docs, id_col, text_col).join(spans, ["id", "own"], "left")
    return rows.select("id", "packed", "spans").mapInArrow(_digests, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
