"""Near-duplicates by the Jaccard similarity of word shingles, found by soft Golay decoding of long SimHashes.

Two texts whose shingle sets have a similarity of 0.8 differ in 15 % of their SimHash bits: about 10 of 64, which keys
for few differing bits do not reach. Here the SimHash has 1,152 bits, each with its margin (how far the vote was from a
tie); 1,104 of them are cut into 48 segments of 23 bits. A segment is decoded to the CODEWORDS nearest codewords of the
Golay code by its margins: the WEAK least certain bits are flipped in every way, each trial is decoded to its one nearest
codeword, and codewords count by the margins of the bits in which they differ. Each of the TABLES takes three segments;
the KEYS best triples of codewords are its keys. A pair is missed only if all tables miss it: of 1,500 simulated pairs 6
at a similarity of 0.8 and 1 at 0.82.

Texts that meet under a key form, with all that meet the same smallest text under any key, a group: a text is a row for
each such smallest text, not for each key. Texts of a group are verified on their whole shingle sets: first each text with
the smallest one that it most often meets, so a family around one text is linked by as many pairs as it has members.
Groups whose smallest texts that has connected become one. Then only groups whose members are still in several components
are gone through, where their members are: pairs of different components that differ in at most LIMIT bits of the SimHash
are verified nearest first, and a pair that another link has joined meanwhile is passed over. Only links leave the task,
fewer than the group has members; no pair is ever a row. A group of more than PART texts (or PART_BYTES of shingles) is
dealt as pairs of its parts. At a similarity of 0.8 a pair differs in 174 bits of 1,152 on average, with a deviation of
12, so LIMIT loses about 1 of 200 pairs right at 0.8.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_bytes, keyed, marked, pieces, written
from .components import connected_components
from .simhash import golay_tables, met_rows

TABLES, CODEWORDS, WEAK, KEYS = 16, 4, 4, 16
SEGMENTS, WIDTH = 3 * TABLES, 23
LANES = -(-SEGMENTS * WIDTH // 64)
#: Odd multipliers that turn a shingle's hash into the bits of each lane.
LANE_FACTORS = np.random.default_rng(1).integers(1, 2**63, LANES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
#: Pairs with more differing bits are not verified.
LIMIT = 205
#: Members of a part of a group, and bytes of their shingles, about; a task holds two parts.
PART, PART_BYTES = 1024, 32 << 20


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct XXH64 of the space-joined shingles, lower-cased A-Z; the whole sequence if there are fewer words."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    k = min(words, len(tokens))
    joined, digest = b" ".join(tokens), xxhash.xxh64_digest
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    return np.unique(np.frombuffer(b"".join([digest(joined[s:e], 42) for s, e in zip(starts, ends)]), ">u8").astype(np.uint64))


def margins(hashes: np.ndarray) -> np.ndarray:
    """Votes of a shingle set for each bit (positive: 1)."""
    ones, step = np.zeros(LANES * 64, np.int64), 1 << 12
    for i in range(0, len(hashes), step):
        x = hashes[i : i + step, None] * LANE_FACTORS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1).sum(0, dtype=np.int64)
    return 2 * ones - len(hashes)


def segments(votes: np.ndarray) -> np.ndarray:
    return votes[: SEGMENTS * WIDTH].reshape(SEGMENTS, WIDTH)


@lru_cache(1)
def _patterns():
    return np.array(list(product((0, 1), repeat=WEAK)), np.int64), np.array(list(product(range(CODEWORDS), repeat=3)))


def soft_codewords(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """votes (n, 23) -> indices of up to CODEWORDS codewords, nearest first, and what their differing bits weigh (inf: none)."""
    places, leader, _ = golay_tables()
    patterns, _ = _patterns()
    bits = 1 << np.arange(WIDTH, dtype=np.int64)
    weight = np.abs(votes).astype(np.float64)
    hard = (votes > 0) @ bits
    weak = np.argpartition(weight, WEAK, axis=1)[:, :WEAK]
    trial = hard[:, None] ^ ((1 << weak) @ patterns.T)
    s = places[0][trial & 255] ^ places[1][trial >> 8 & 255] ^ places[2][trial >> 16]
    word = np.sort(trial ^ leader[s], axis=1)
    differ = (((word ^ hard[:, None])[:, :, None] >> np.arange(WIDTH)) & 1).astype(bool)
    cost = np.where(differ, weight[:, None, :], 0).sum(2)
    cost[:, 1:][word[:, 1:] == word[:, :-1]] = np.inf
    best = np.argsort(cost, axis=1, kind="stable")[:, :CODEWORDS]
    return np.take_along_axis(word, best, 1) >> 11, np.take_along_axis(cost, best, 1)


def soft_keys(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """votes (n, SEGMENTS, 23) -> keys (n, TABLES * KEYS) and which of them exist."""
    _, triples = _patterns()
    n = len(votes)
    word, cost = soft_codewords(votes.reshape(-1, WIDTH))
    word, cost = word.reshape(n, TABLES, 3, CODEWORDS), cost.reshape(n, TABLES, 3, CODEWORDS)
    total = sum(cost[:, :, k, triples[:, k]] for k in range(3))
    best = np.argsort(total, axis=2, kind="stable")[:, :, :KEYS]
    found = np.zeros_like(best)
    for k in range(3):
        found = found << 12 | np.take_along_axis(word[:, :, k, :], triples[:, k][best], 2)
    keys = found | np.arange(TABLES, dtype=np.int64)[:, None] << 36
    return keys.reshape(n, -1), np.isfinite(np.take_along_axis(total, best, 2)).reshape(n, -1)


def _digests(batches):
    """Digests of the sequences of words: equal ones have equal shingles."""
    import pyarrow as pa
    import xxhash

    for batch in batches:
        for part in pieces(batch, 4 << 20):
            sums = [xxhash.xxh3_128_digest(b" ".join(x.lower().split())) for x in arrow_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums, pa.binary())], ["id", "digest"])


def _keys(batches, words):
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, 4 << 20):
            for at in range(0, part.num_rows, 256):
                rows = part.slice(at, 256)
                sets = [shingle_set(x, words) for x in arrow_bytes(rows.column(1))]
                keys, ok = soft_keys(np.stack([segments(margins(x)) for x in sets]))
                ok &= np.array([len(x) > 0 for x in sets])[:, None]
                node = np.repeat(rows.column(0).to_numpy(), ok.sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(keys[ok]), pa.array(node)], ["key", "node"])


def _sets(batches, words):
    """(node, shingles, bits): the whole set, and its SimHash."""
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, 4 << 20):
            sets = [shingle_set(x, words) for x in arrow_bytes(part.column(1))]
            bits = [np.packbits(margins(x) > 0).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(bits, pa.binary())], ["node", "shingles", "bits"])


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def _verified(batches, similarity):
    """Rows (u, v, shingles of u, shingles of v) -> the pairs of at least this similarity."""
    import pyarrow as pa

    for batch in batches:
        ok = [similar(*(np.frombuffer(z.as_buffer(), np.uint64) for z in pair), similarity) for pair in zip(batch.column(2), batch.column(3))]
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["u", "v"])


def group_links(node: np.ndarray, component: np.ndarray, part: np.ndarray, bits: np.ndarray, sets: list, similarity: float) -> list[tuple[int, int]]:
    """Links (node, node) that join the components of a group's members: see above. bits: a matrix of 64-bit words. Where
    the members are of two parts only pairs across them are looked at, each part by itself being a row of its own."""
    n, out = len(node), []
    _, group = np.unique(component, return_inverse=True)
    apart = part[:, None] != part[None, :] if part.min() != part.max() else np.True_
    near, step = [], max(1, (1 << 18) // n)
    for i in range(0, n, step):
        far = sum(np.bitwise_count(bits[i : i + step, None, lane] ^ bits[None, :, lane]).astype(np.uint16) for lane in range(bits.shape[1]))
        ok = (far <= LIMIT) & (group[i : i + step, None] != group[None, :]) & (np.arange(i, min(n, i + step))[:, None] < np.arange(n))
        a, b = np.nonzero(ok & (apart if apart.ndim == 0 else apart[i : i + step]))
        near.append((far[a, b], (a + i).astype(np.int32), b.astype(np.int32)))
    far, a, b = (np.concatenate(x) for x in zip(*near))
    root = list(range(int(group.max()) + 1))

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    order = np.argsort(far, kind="stable")
    for i, j in zip(a[order].tolist(), b[order].tolist()):
        x, y = top(int(group[i])), top(int(group[j]))
        if x != y and similar(sets[i], sets[j], similarity):
            root[max(x, y)] = min(x, y)
            out.append((int(node[i]), int(node[j])))
    return out


def _group_links(batches, similarity):
    """Rows (key, block, part, node, component, bits, shingles) sorted by key and block -> links (u, v)."""
    import pyarrow as pa

    def done(rows):
        node, component, part = (np.array([r[i] for r in rows]) for i in (3, 4, 2))
        found = group_links(node, component, part, np.frombuffer(b"".join(r[5] for r in rows), np.uint64).reshape(len(rows), -1), [np.frombuffer(r[6], np.uint64) for r in rows], similarity)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    rows = []
    for batch in batches:
        for k in range(batch.num_rows):
            r = [c[k].as_py() for c in batch.columns]
            if rows and rows[-1][:2] != r[:2]:
                yield done(rows)
                rows = []
            rows.append(r)
    if rows:
        yield done(rows)


def _first_pairs(meets: DataFrame) -> DataFrame:
    """Each node with the low that it most often meets."""
    often = meets.where("node <> low").groupBy("node").agg(F.max(F.struct("n", (-F.col("low")).alias("other"))).alias("best"))
    return often.select((-F.col("best.other")).alias("u"), F.col("node").alias("v"))


def _spread_links(meets: DataFrame, sets: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links within the groups whose members are in several components of the links found so far."""
    rows = meets.select(F.col("low").alias("key"), "node").join(written(connected_components(found), "labels").hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = written(rows.select("key", "node", "component"), "labelled")
    known = sets.dropDuplicates(["node"]).withColumn("size", F.length("shingles").cast("long"))
    sizes = written(known.select("node", "size"), "sizes")
    spread = rows.join(sizes.hint("merge"), "node").groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum("size").alias("bytes")).where("low < high")
    rows = rows.join(written(spread.select("key", "n", "bytes"), "spread").hint("merge"), "key")
    parts = F.ceil(F.greatest(F.col("n") / PART, F.col("bytes") / PART_BYTES)).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    rows = rows.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.least(x, F.col("part")) * parts + F.greatest(x, F.col("part")))))
    rows = written(rows.select("key", "block", "part", "node", "component"), "blocks").join(known.hint("merge"), "node").select("key", "block", "part", "node", "component", "bits", "shingles")
    return rows.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(lambda b: _group_links(b, similarity), "u long, v long")


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (id, digest, component), the digest of its sequence of words and the smallest id that
    links of at least `similarity` reach.

    Links are judged on the whole sets of distinct shingles. Rows with equal sequences count once, texts without a word
    (null, empty) are copies of each other; a null id counts as the smallest; rows that repeat an id are copies of each
    other; no rows give no rows; other columns are not looked at. Texts are shuffled only where an id may be a copy's or
    has met another one (see marked).
    """
    texts = keyed(docs, id_col, text_col, "text")
    nodes = written(texts.mapInArrow(_digests, "id long, digest binary"), "digests")
    lows = written(nodes.groupBy("digest").agg(F.min("id").alias("v")), "lows")
    links = written(nodes.join(lows.hint("merge"), "digest").where("id <> v").select(F.col("id").alias("u"), "v"), "copies")
    copies = written(links.select("u").distinct().join(lows.select(F.col("v").alias("u")).distinct().hint("merge"), "u", "left_anti"), "copied")
    keys = marked(texts, copies).where("not marked").select("id", "text").mapInArrow(lambda b: _keys(b, words), "key long, node long")
    met = keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(met_rows, "key long, node long, low long")
    meets = written(met.groupBy("low", "node").agg(F.count("*").alias("n")), "meets")
    members = written(meets.select("node").distinct(), "members")
    sets = written(marked(texts, members).where("marked").select("id", "text").mapInArrow(lambda b: _sets(b, words), "node long, shingles binary, bits binary"), "sets")
    one, two = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)).hint("merge") for n, s in (("u", "a"), ("v", "b")))
    # The other one first: a node that many pairs share comes last, and its set is not shuffled for each of them.
    pairs = written(_first_pairs(meets), "pairs")
    found = written(pairs.select("u", "v").join(two, "v").join(one, "u").select("u", "v", "a", "b").mapInArrow(lambda b: _verified(b, similarity), "u long, v long"), "links")
    # Groups of the same component's smallest texts are one group from here on.
    tops = written(connected_components(found), "tops").select(F.col("node").alias("low"), F.col("component").alias("top"))
    meets = written(meets.join(tops.hint("merge"), "low", "left").select(F.coalesce("top", "low").alias("low"), "node").distinct(), "meets")
    links = links.union(found).union(written(_spread_links(meets, sets, found, similarity), "links"))
    groups = written(connected_components(links), "groups")
    return nodes.join(groups.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("id", "digest", F.coalesce("component", "id").alias("component"))
