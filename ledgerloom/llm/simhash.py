"""SimHash near-duplicates by fuzzy hashing with the binary Golay code (23, 12, 7).

A 64-bit fingerprint is cut into three segments of 21 or 22 bits, each a word of 23 bits with leading zeros. The
code is perfect: each word lies within 3 bits of one codeword, and a word at distance 3 has five more at distance 4.
Two words within 2 bits share one of these up to six codewords, and of two words at distance 1, each one's nearest
codeword is among the other's six.

Pigeonhole: with at most 4 differing bits over three segments, either each segment has at most 2 of them, or one has 3
or 4 and the other two have at most 1 together. In the first case the fingerprints share a triple of codewords of which
two may be near ones and one is the nearest (about 70 keys of 36 bits). In the second, one of the other two segments
is equal and the remaining one is at distance 1 or 0: they share the equal segment with a near codeword of the other
(about 32 keys of 33 bits). Fingerprints that meet under a key are verified by their differing bits. With keys that
long, chance meetings stay rare: 29 keys of 24 bits would do too, but their meetings grow with the square of the input.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, permutations, product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, keyed, pieces, written
from .components import connected_components

#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (a fixed value).
GENERATOR = 0xAE3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 4
#: Rows of a key that are compared in one go; larger keys are split into pairs of such blocks.
BLOCK = 1024
#: Fingerprints whose keys a task works out: a fingerprint has about 100 keys.
PRINTS_A_TASK = 8192


@lru_cache(1)
def golay_tables():
    """Syndromes of bytes at three places, nearest-codeword error and the errors of weight 4 for each syndrome."""
    words = np.arange(256, dtype=np.int64)
    places = []
    for shift in (0, 8, 16):
        x = words << shift
        for bit in range(23, 10, -1):
            x = np.where((x >> bit) & 1, x ^ (GENERATOR << (bit - 11)), x)
        places.append(x)
    leader = np.zeros(2048, np.int64)
    far = np.full((2048, 5), -1, np.int64)
    filled = np.zeros(2048, int)
    for weight in (1, 2, 3, 4):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = places[0][e & 255] ^ places[1][e >> 8 & 255] ^ places[2][e >> 16]
            if weight < 4:
                leader[s] = e
            else:
                far[s, filled[s]] = e
                filled[s] += 1
    return places, leader, far


def near_codewords(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within 4 bits of each 23-bit word: nearest first, -1 where there are fewer."""
    places, leader, far = golay_tables()
    s = places[0][words & 255] ^ places[1][words >> 8 & 255] ^ places[2][words >> 16]
    more = far[s]
    return np.column_stack([(words ^ leader[s]) >> 11, np.where(more < 0, -1, (words[:, None] ^ np.maximum(more, 0)) >> 11)])


def fingerprint_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (int64) and the rows that they belong to."""
    prints = prints.view(np.uint64)
    near = [near_codewords(((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    whole = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    keys, rows = [], []

    def add(kind, found, ok):
        ok = np.flatnonzero(ok)
        keys.append(kind << 48 | found[ok])
        rows.append(ok)

    for a, b, c in product(range(6), repeat=3):
        if 0 in (a, b, c):
            add(0, near[0][:, a] << 24 | near[1][:, b] << 12 | near[2][:, c], (near[0][:, a] >= 0) & (near[1][:, b] >= 0) & (near[2][:, c] >= 0))
    for kind, (i, j) in enumerate(permutations(range(3), 2), 1):
        for c in range(6):
            add(kind, whole[i] << 12 | near[j][:, c], near[j][:, c] >= 0)
    return np.concatenate(keys), np.concatenate(rows)


def text_fingerprint(text: bytes, words: int) -> int:
    """SimHash of the space-joined shingles of `words` words, lower-cased A-Z, repeats included; 0 without a word."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return 0
    k = min(words, len(tokens))
    joined, digest = b" ".join(tokens), xxhash.xxh64_digest
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    ones, step = np.zeros(64, np.int64), 1 << 14
    starts, ends = (ends - size)[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    for i in range(0, len(starts), step):
        hashes = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[i : i + step], ends[i : i + step])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def _fingerprints(batches, words):
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch):
            prints = np.array([text_fingerprint(x, words) for x in arrow_bytes(part.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], ["id", "print"])


def _keys(batches):
    import pyarrow as pa

    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), PRINTS_A_TASK):
            keys, rows = fingerprint_keys(prints[at : at + PRINTS_A_TASK])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[at + rows])], ["key", "node"])


def met_rows(batches):
    """Rows (key, node) sorted by both -> those of keys with at least two rows, with the key's first node as low."""
    import pyarrow as pa

    alone, last, low_of_last = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (batch.column(i).to_numpy() for i in (0, 1))
        if alone is not None:
            key, node = np.r_[alone[0], key], np.r_[alone[1], node]
        start = np.r_[True, key[1:] != key[:-1]]
        run, first = np.cumsum(start) - 1, np.flatnonzero(start)
        low, met = node[first][run], np.bincount(run)[run] > 1
        if key[0] == last:  # the run began in an earlier batch
            low[run == 0], met[run == 0] = low_of_last, True
        alone = None if met[-1] else (key[-1:], node[-1:])
        last, low_of_last = (key[-1], low[-1]) if met[-1] else (None, None)
        yield pa.RecordBatch.from_arrays([pa.array(x[met]) for x in (key, node, low)], ["key", "node", "low"])


def spanning_links(node: np.ndarray, prints: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of at most `bits` differing bits that connect what such links connect; at most one for each row."""
    left, out = np.arange(len(node)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at, front = front[0], front[1:]
            hit = np.bitwise_count(prints[left] ^ prints[at]) <= bits
            if hit.any():
                new, left = left[hit], left[~hit]
                out.append((np.full(len(new), node[at]), node[new]))
                front = np.concatenate([front, new])
    return out


def _links(batches, bits):
    """Sorted rows (key, block, print) -> links of prints within each (key, block)."""
    import pyarrow as pa

    def done(key, block, node):
        if not len(key):
            return
        prints = node.view(np.uint64)
        cut = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(key)]
        size, u, v = ends - starts, [], []
        for n in np.unique(size[(size > 1) & (size <= 24)]):
            at = starts[size == n]
            for i in range(n):
                for j in range(i + 1, n):
                    hit = np.bitwise_count(prints[at + i] ^ prints[at + j]) <= bits
                    u.append(node[at + i][hit])
                    v.append(node[at + j][hit])
        for s, e in zip(starts[size > 24], ends[size > 24]):
            for a, b in spanning_links(node[s:e], prints[s:e], bits):
                u.append(a)
                v.append(b)
        if u and sum(map(len, u)):
            pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    kept = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if kept is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(kept, cols)]
        if not len(cols[0]):
            continue
        whole = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        last = whole[-1] + 1 if len(whole) else 0
        yield from done(*[c[:last] for c in cols])
        kept = [c[last:] for c in cols]
    if kept is not None:
        yield from done(*kept)


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print): the SimHash of every row as a long. Null text counts as empty; equal ids stay separate rows."""
    return keyed(docs, id_col, text_col, "text").mapInArrow(lambda b: _fingerprints(b, words), "id long, print long")


def fingerprint_components(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(print, component) of fingerprints (id, print): the smallest id that links of at most `bits` bits reach.

    bits: 4 at most. Copies count once: only distinct fingerprints get keys. Keys with many fingerprints are split
    into pairs of blocks of at most BLOCK rows, each of which gives a spanning set of links, never all pairs.
    """
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the segments cover at most {MAX_BITS} differing bits")
    nodes = written(prints.groupBy("print").agg(F.min("id").alias("node")), "nodes")
    spread = nodes.select("print").repartition(max(1, -(-nodes.count() // PRINTS_A_TASK)), "print")
    keys = spread.mapInArrow(_keys, "key long, node long")
    met = written(keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(met_rows, "key long, node long, low long").select("key", "node"), "met")
    many = met.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = met.join(written(many, "many").hint("merge"), "key").select("key", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, own) * F.col("blocks") + F.greatest(x, own))).alias("block"), "node")
    links = dealt.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(lambda b: _links(b, bits), "u long, v long")
    found = written(nodes.join(connected_components(links).select(F.col("node").alias("print"), F.col("component").alias("top")).hint("merge"), "print", "left").withColumn("top", F.coalesce("top", "print")), "found")
    lows = written(found.groupBy("top").agg(F.min("node").alias("component")), "lows")
    return found.join(lows.hint("merge"), "top").select("print", "component")


def simhash_near_duplicates(docs: DataFrame, words: int = 4, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (id, print, component).

    Null or empty text has fingerprint 0 and links like any other; a null id counts as the smallest; rows that repeat
    an id each give a row; no rows give no rows; other columns are not looked at.
    """
    prints = written(fingerprints(docs, words, id_col, text_col), "prints")
    return prints.join(written(fingerprint_components(prints, bits), "components").hint("merge"), "print").select("id", "print", "component")
