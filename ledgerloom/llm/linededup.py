"""Removal of lines that many documents share.

Only hashes travel: every line whose key is long enough gives one row (hash, document, position). The rows are
range-partitioned by hash, document and position, so that the rows of one very common line spread over as many
partitions as their number asks for, and sorted within. A task streams its rows: the first occurrence in a run of
equal hashes is in the document that keeps the line. Runs at a partition's edges may go on in the next one; their rows
are set aside and settled with totals of those few hashes (at most two for each partition). What is returned is one
compressed keep bitmap for each document that loses a line.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, arrow_bytes, keyed, pieces, written

MIN_CHARS, MIN_DOCS = 20, 3
STRIPPED = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: bytes) -> bytes:
    return line.strip(STRIPPED).lower()


def _code_points(x: bytes) -> int:
    return len(x) if x.isascii() else len(x.decode("utf-8", "replace"))


def _hash(x: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(x)


def _lines(batches, min_chars):
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch):
            ids, own = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            rows, at, hashes, total = [], [], [], []
            for k, text in enumerate(arrow_bytes(part.column(1))):
                lines = text.split(b"\n")
                for i, line in enumerate(lines):
                    if len(line) >= min_chars and _code_points(key := line_key(line)) >= min_chars:
                        rows.append(k)
                        at.append(i)
                        hashes.append(_hash(key))
                        total.append(len(lines))
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(ids[np.array(rows, int)]), pa.array(own[np.array(rows, int)]), pa.array(np.array(at, np.int32)), pa.array(np.array(total, np.int32))], ["h1", "h2", "id", "text", "at", "lines"])


LINE_ROWS = "h1 long, h2 long, id long, text long, at int, lines int"


class _Run:
    """The run of equal hashes in hand while a partition streams by."""

    def __init__(self, rows, first, min_docs):
        self.key, self.first, self.min_docs = (rows[0][0], rows[1][0]), first, min_docs
        self.docs, self.top, self.last, self.held = 0, rows[2][0], None, []

    def add(self, rows):
        """Takes rows of the run; gives those whose fate is known, with the mark of those to settle later."""
        if not len(rows[0]):
            return
        self.docs += int((rows[2][1:] != rows[2][:-1]).sum()) + (self.last is None or rows[2][0] != self.last)
        self.last = rows[2][-1]
        if self.first:
            yield rows, True
            return
        self.held.append(rows)
        if self.docs >= self.min_docs:
            for x in self.held:
                lost = x[2] != self.top
                yield [c[lost] for c in x], False
            self.held = []

    def end(self, at_edge):
        if at_edge and not self.first:
            for x in self.held:
                yield x, True
        if at_edge or self.first:  # a summary: its position is -1, its lines are the documents
            yield [np.array([x], t) for x, t in zip((*self.key, self.top, 0, -1, self.docs), ("i8", "i8", "i8", "i8", "i4", "i4"))], True


def _stream(batches, min_docs):
    """Rows sorted by (h1, h2, id descending): rows that lose their line; edge = true: to settle, or a summary (at = -1)."""
    import pyarrow as pa

    def batch_of(rows, edge):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows] + [pa.array(np.full(len(rows[0]), edge))], ["h1", "h2", "id", "text", "at", "lines", "edge"])

    run = None
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        if not len(rows[0]):
            continue
        cut = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
        bounds = np.r_[0, cut, len(rows[0])]
        part = lambda k, n=1: [c[bounds[k] : bounds[k + n]] for c in rows]
        if run is None:
            run = _Run(rows, True, min_docs)
        k = 0
        if run.key == (rows[0][0], rows[1][0]):
            for x in run.add(part(0)):
                yield batch_of(*x)
            k = 1
        if k == len(bounds) - 1:
            continue
        for x in run.end(False):
            yield batch_of(*x)
        n = len(bounds) - 2 - k  # whole runs inside the batch
        if n:
            own, starts = part(k, n), bounds[k : k + n] - bounds[k]
            new = np.r_[True, own[2][1:] != own[2][:-1]]
            new[starts] = True
            size = np.diff(np.r_[starts, len(own[0])])
            lost = np.repeat(np.add.reduceat(new.astype(np.int64), starts) >= min_docs, size) & (own[2] != np.repeat(own[2][starts], size))
            yield batch_of([c[lost] for c in own], False)
        run = _Run(part(len(bounds) - 2), False, min_docs)
        for x in run.add(part(len(bounds) - 2)):
            yield batch_of(*x)
    if run is not None:
        for x in run.end(True):
            yield batch_of(*x)


def _bitmaps(batches):
    import pyarrow as pa

    for batch in batches:
        lost, maps = [], []
        for n, at in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            keep = np.ones(n, bool)
            keep[at] = False
            lost.append(n - int(keep.sum()))
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lost, pa.int32()), pa.array(maps, pa.binary())], ["id", "text", "lines", "lost", "keep"])


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, text, lines, lost, keep): a compressed bitmap over the lines of each document that loses any.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least `min_chars` code
    points in at least `min_docs` documents keep their lines only in the document with the largest id (a null id is
    the smallest). `text` is a hash of the text: rows that repeat an id count as one document, and each has its own
    bitmap. Null and empty texts have one empty line and lose nothing; no rows give no rows.
    """
    lines = written(keyed(docs, id_col, text_col, "text").withColumn("own", F.xxhash64("text")).mapInArrow(lambda b: _lines(b, min_chars), LINE_ROWS), "lines")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h1"), F.col("h2"), F.col("id").desc()]
    dealt = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text", "at")
    fate = written(dealt.mapInArrow(lambda b: _stream(b, min_docs), LINE_ROWS + ", edge boolean"), "fate")
    # At most two summaries for each partition: small whatever the input.
    totals = fate.where("edge and at < 0").groupBy("h1", "h2").agg(F.sum("lines").alias("docs"), F.max("id").alias("top"))
    settled = fate.where("edge and at >= 0").join(F.broadcast(totals), ["h1", "h2"]).where(f"docs >= {min_docs} and id <> top")
    lost = fate.where("not edge").unionByName(settled, allowMissingColumns=True)
    return lost.groupBy("id", "text").agg(F.first("lines").alias("lines"), F.collect_list("at").alias("at")).mapInArrow(_bitmaps, "id long, text long, lines int, lost int, keep binary")


def kept_text(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """The text without its lost lines, lines before and lines lost."""
    lines = text.split(b"\n")
    if keep is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).astype(bool)
    stay = [x for x, k in zip(lines, bits) if k]
    return b"\n".join(stay), len(lines), len(lines) - len(stay)


def with_keep_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the column __keep: null where a document keeps all its lines."""
    rows = docs.withColumn("__id", F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID))).withColumn("__hash", F.xxhash64(docs[text_col]))
    maps = bitmaps.select(F.col("id").alias("__id"), F.col("text").alias("__hash"), F.col("keep").alias("__keep"))
    return rows.join(maps, ["__id", "__hash"], "left").drop("__id", "__hash")


def _kept(batches, text_at, keep_at, emit):
    for batch in batches:
        for part in pieces(batch):
            found = [kept_text(t, k) for t, k in zip(arrow_bytes(part.column(text_at)), part.column(keep_at).to_pylist())]
            yield emit(part, found)


def line_digests(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) for each row of docs."""

    def emit(part, found):
        import hashlib

        import pyarrow as pa

        return pa.RecordBatch.from_arrays([part.column(0), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in found])], ["id", "n_lines", "n_dropped", "kept_sha256"])

    rows = with_keep_bitmaps(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), bitmaps, "id")
    return rows.mapInArrow(lambda b: _kept(b, 1, 2, emit), "id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """docs, all columns and rows, each text without the lines it loses; a null text stays null."""
    bitmaps = line_keep_bitmaps(docs, id_col, text_col, **limits)
    names = docs.columns
    at = names.index(text_col)

    def emit(part, found):
        import pyarrow as pa

        texts = pa.array([None if not ok else x[0].decode("utf-8", "replace") for x, ok in zip(found, part.column(at).is_valid().to_pylist())], pa.string())
        return pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(part.columns[: len(names)])], names)

    return with_keep_bitmaps(docs, bitmaps, id_col, text_col).mapInArrow(lambda b: _kept(b, at, len(names), emit), docs.schema)
