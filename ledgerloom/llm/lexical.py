"""Ranked lexical search of all documents for a set of items, by groups of equal presence masks.

Terms are the words of `words.py`. The items are dealt in blocks of bounded many terms. For each block every document is
read once and kept as the list of the block's terms that it holds, with their frequencies (postings by document); their
document frequencies are sums of one vector for each task.

Then each task goes through its documents in batches. A term's presence in the batch is one row of bits; an item's rows
side by side give every document's mask of matched terms, and documents of one mask are a group. No document of a group
can score more than the sum, over the mask, of each term's weight times its best contribution in the batch. Groups are
evaluated by descending maximum, together with what the task's earlier batches have left; once the item's k-th best score
is above the next maximum, the rest is safely out. A task returns at most k documents for each item; the best k of all
tasks are the result. Equal scores are decided by the document's id, so a group whose maximum equals the k-th score is
still evaluated.
"""

from __future__ import annotations

from math import floor, log

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, shown_id, written
from .words import Words, text_slices

#: About as many different terms of items are looked for in one reading of the documents.
TERMS_A_BLOCK = 1 << 16
#: Cells (terms by documents) of a batch's table of contributions.
CELLS = 1 << 22
#: Groups that are evaluated together.
GROUPS = 64


def _item_terms(batches):
    import pyarrow as pa

    for part, w in text_slices(batches):
        ids, out = part.column(0), ([], [], [])
        for t in range(w.n_texts):
            own = sorted({w.word(i) for i in range(int(w.first[t]), int(w.first[t + 1]))})
            out[0].extend([t] * len(own))
            out[1].extend(own)
        hashed = Words(out[1]).hashes().view(np.int64) if out[1] else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(out[0], pa.int64())), pa.array([x.decode("utf-8", "replace") for x in out[1]], pa.string()), pa.array(hashed)], ["item", "term", "hash"])


def _postings(batches, vocabulary):
    """(id, n, terms, tfs) of every text with a term: numbers of the vocabulary's terms that it holds, with frequencies."""
    import pyarrow as pa

    known, spelt = vocabulary.value
    for part, w in text_slices(batches):
        ids, n = part.column(0).to_numpy(zero_copy_only=False), np.diff(w.first)
        hashed = w.hashes()
        at = np.minimum(np.searchsorted(known, hashed), max(0, len(known) - 1))
        mine = np.flatnonzero(known[at] == hashed) if len(known) else np.empty(0, np.int64)
        at = at[mine]
        terms, first = np.unique(at, return_index=True)  # the spelling of each term settles what its hash says
        wrong = [t for t, i in zip(terms.tolist(), mine[first].tolist()) if w.word(i) != spelt[t]]
        if wrong:
            on = ~np.isin(at, wrong)
            mine, at = mine[on], at[on]
        cell, tf = np.unique(w.text[mine] * len(known) + at, return_counts=True)
        text, term = cell // max(1, len(known)), cell % max(1, len(known))
        has = np.flatnonzero(n > 0)
        ends = np.r_[0, np.cumsum(np.bincount(text, minlength=w.n_texts))[has]].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(n[has]), pa.ListArray.from_arrays(pa.array(ends), pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int32)))], ["id", "n", "terms", "tfs"])


def _frequencies(batches, size):
    """(term, df, n): how many texts of the task hold each term; term -1 counts the texts and their terms with repeats."""
    import pyarrow as pa

    df, texts, length = np.zeros(size, np.int64), 0, 0
    for batch in batches:
        df += np.bincount(batch.column(1).flatten().to_numpy(), minlength=size)
        texts, length = texts + batch.num_rows, length + int(batch.column(0).to_numpy().sum())
    there = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, there]), pa.array(np.r_[texts, df[there]]), pa.array(np.r_[length, np.zeros(len(there), np.int64)])], ["term", "df", "n"])


def weights(df: list[int], n: int) -> list[int]:
    return [floor(1000 * log((2 * n + 2) / (2 * d + 1))) for d in df]


class Best:
    """The k best (score, id) of an item: highest score, then smallest id."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> int:
        """What a document must reach to matter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray):
        on = score >= self.least()
        if on.any():
            score, ids = np.r_[self.score, score[on]], np.r_[self.id, ids[on]]
            order = np.lexsort((ids, -score))[: self.k]
            self.score, self.id = score[order], ids[order]


def rank_batch(best: list[Best], items: list[np.ndarray], weight: np.ndarray, ids, n, text, term, tf, texts: int, length: int, together: int = GROUPS):
    """Takes the documents of one batch (ids, n; text, term, tf for each posting) into each item's best."""
    used, row = np.unique(term, return_inverse=True)
    m = 100 - 50 + (50 * n * texts) // length
    part = (1_000_000_000 * tf) // (1000 * tf + 20 * m[text])
    table = np.zeros((len(used), len(ids)), np.int64)
    table[row, text] = part
    present, top = np.packbits(table > 0, axis=1), table.max(1, initial=0) * weight[used]
    for own, found in zip(items, best):
        rows = np.searchsorted(used, own)
        rows = rows[(rows < len(used)) & (used[np.minimum(rows, len(used) - 1)] == own)] if len(used) else rows[:0]
        if not len(rows) or top[rows].sum() < found.least():
            continue
        bits = np.unpackbits(present[rows], axis=1, count=len(ids))
        any_bit = np.flatnonzero(bits.any(0))
        mask = np.ascontiguousarray(np.packbits(bits[:, any_bit], axis=0).T)
        masks, group = np.unique(mask.view(np.dtype((np.void, mask.shape[1]))).ravel(), return_inverse=True)
        matched = np.unpackbits(masks.view(np.uint8).reshape(len(masks), -1), axis=1, count=len(rows))
        most = matched.astype(np.int64) @ top[rows]
        order, w = np.argsort(-most, kind="stable"), weight[used[rows]]
        members = np.argsort(group, kind="stable")
        begin = np.r_[0, np.cumsum(np.bincount(group, minlength=len(masks)))]
        for i in range(0, len(order), together):
            some = order[i : i + together]
            if most[some[0]] < found.least():
                break
            docs = any_bit[np.concatenate([members[begin[g] : begin[g + 1]] for g in some])]
            found.add((table[np.ix_(rows, docs)] * w[:, None]).sum(0), ids[docs])


def _ranked(batches, plan, k):
    """(item, id, score): at most k of each item for the task's documents."""
    import pyarrow as pa

    names, items, weight, texts, length, cells, together = plan.value
    best = [Best(k) for _ in items]
    step = max(64, cells // max(1, len(weight)))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            rows = batch.slice(i, step)
            ids, n = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            lists = rows.column(2)
            sizes = lists.value_lengths().to_numpy()
            rank_batch(best, items, weight, ids, n, np.repeat(np.arange(len(ids)), sizes), lists.flatten().to_numpy(), rows.column(3).flatten().to_numpy().astype(np.int64), texts, length, together)
    for name, found in zip(names, best):
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(found.id), pa.int64()), pa.array(found.id), pa.array(found.score)], ["item", "id", "score"])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): the k documents of highest score above 0 for each item, equal scores by ascending id.

    Documents without a term (null, empty) are in no count and no result; items without a term have no row. A null
    document id is the smallest and is shown as null, a null item id is one item by itself; rows that repeat an item id are one item with the
    terms of all; each row of docs is a document, also where it repeats an id, and such rows of equal score take
    neighbouring ranks. Empty tables give no rows; other columns are not looked at. A very long text is one row: about 30 bytes of memory for each of its bytes.
    """
    spark = docs.sparkSession
    terms = written(keyed(items, item_col, item_text, "text").mapInArrow(_item_terms, "item long, term string, hash long").distinct(), "terms")
    total = terms.select("hash").distinct().count()
    blocks = max(1, -(-total // TERMS_A_BLOCK))
    found = [_searched(spark, docs, terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k, id_col, text_col) for b in range(blocks)]
    result = found[0]
    for other in found[1:]:
        result = result.unionByName(other)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    result = result.withColumn("rank", rank).where(F.col("rank") <= k)
    return result.select(shown_id("item").alias("item"), "rank", shown_id().alias("id"), "score")


def _searched(spark, docs: DataFrame, terms: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, id, score) of each task's best for a block of items, whose terms (about TERMS_A_BLOCK) come to the driver."""
    rows = terms.collect()
    spelt = {r["hash"] & (1 << 64) - 1: r["term"].encode() for r in rows}
    known = np.array(sorted(spelt), np.uint64)
    number = {h: i for i, h in enumerate(known.tolist())}
    vocabulary = spark.sparkContext.broadcast((known, [spelt[h] for h in known.tolist()]))
    postings = written(keyed(docs, id_col, text_col, "text").mapInArrow(lambda b: _postings(b, vocabulary), "id long, n long, terms array<int>, tfs array<int>"), "postings")
    counts = postings.select("n", "terms").mapInArrow(lambda b: _frequencies(b, len(known)), "term long, df long, n long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect()
    df = {r["term"]: (r["df"], r["n"]) for r in counts}
    texts, length = df.get(-1, (0, 0))
    weight = np.array(weights([df.get(t, (0, 0))[0] for t in range(len(known))], texts), np.int64)
    own: dict[int, list[int]] = {}
    for r in rows:
        own.setdefault(r["item"], []).append(number[r["hash"] & (1 << 64) - 1])
    names = sorted(own)
    plan = spark.sparkContext.broadcast((names, [np.array(sorted(own[i]), np.int64) for i in names], weight, texts, max(1, length), CELLS, GROUPS))
    return postings.mapInArrow(lambda b: _ranked(b, plan, k), "item long, id long, score long")
