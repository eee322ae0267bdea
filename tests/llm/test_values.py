"""Values that the text operators give for odd rows: null, empty, blank, very long, repeated and tied ones, null and
repeated ids, extra columns with names that operators use inside; each against a plain version."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import linededup, mixing, ngramlm, quality, queries, repeats, shingles, simhash
from ledgerloom.llm.common import NULL_ID

from .test_llm import COLS, LONG, ROWS, SF, row
from .test_quality import base

LINE = "This line is common to many documents"
MORE = ROWS + [row(i, f"{LINE}\nown line of {i}\n  {LINE.upper()}\t") for i in (None, 10, 11, 11)] + [row(12, "z" * 900), row(13, "short")]
WHITE = b" \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(MORE, COLS)


def own_id(i):
    return NULL_ID if i is None else i


def rows_of(found, *cols):
    return sorted(tuple(r[c] for c in cols) for r in found.collect())


def test_simhash_values(docs):
    prints = []
    for i, text, *_ in MORE:
        words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    low = [own_id(r[0]) for r in MORE]
    for _ in MORE:
        for a in range(len(MORE)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    low[a] = low[b] = min(low[a], low[b])
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    assert rows_of(simhash.simhash_near_duplicates(docs), "id", "print", "component") == sorted(zip(map(own_id, [r[0] for r in MORE]), signed, low))


def test_line_values(docs):
    """A key counts once for each id; only the largest id that has it keeps its lines, all of them."""
    holders = defaultdict(set)
    for i, text, *_ in MORE:
        for line in (text or "").encode().split(b"\n"):
            holders[line.strip(WHITE).lower()].add(own_id(i))
    want = []
    for i, text, *_ in MORE:
        lines = (text or "").encode().split(b"\n")
        keys = [x.strip(WHITE).lower() for x in lines]
        stay = [x for x, k in zip(lines, keys) if not (len(k.decode()) >= 20 and len(holders[k]) >= 3 and own_id(i) != max(holders[k]))]
        want.append((own_id(i) if i is not None else NULL_ID, len(lines), len(lines) - len(stay), hashlib.sha256(b"\n".join(stay)).hexdigest()))
    got = linededup.line_digests(docs, linededup.line_keep_bitmaps(docs)).withColumn("id", F.coalesce("id", F.lit(NULL_ID)))
    assert rows_of(got, "id", "n_lines", "n_dropped", "kept_sha256") == sorted(want) and sum(w[2] for w in want) == 4


def test_repeat_values(docs):
    raw = [(own_id(r[0]), (r[1] or "").encode()) for r in MORE]
    seen = Counter(t[k : k + 400] for _, t in raw for k in range(len(t) - 399))
    want = []
    for i, t in raw:
        gone = np.zeros(len(t) + 1, bool)
        end = 0
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[max(k, end) : k + 400] = True
                end = k + 400
        runs = int((np.diff(np.r_[0, gone.astype(int)]) > 0).sum())
        want.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()).hexdigest()))
    assert rows_of(repeats.repeat_digests(docs), "id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want)


def test_lm_values(docs):
    """A null id counts as the empty text, so its rows are learned from; null texts are one end token."""
    tokens = [(r[0], (r[1] or "").encode().lower().split() + [None]) for r in MORE]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in tokens]
    count = Counter(w for h, (_, t) in zip(held, tokens) if not h for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted((own_id(i), h, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for h, (i, t) in zip(held, tokens))
    got = sorted((own_id(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in ngramlm.lm_scores(docs).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want])


def test_quality_values(spark, docs):
    found = quality.quality_rules(docs, spark.createDataFrame([(4,), (None,)], "doc_id long"))
    got = sorted((own_id(r["doc_id"]), *tuple(r["q"])) for r in found.select("doc_id", F.col("__q").alias("q")).collect())
    assert got == sorted((own_id(r[0]), *base(r[1])) for r in MORE)
    assert all(not r["__kept"] and r["__score"] == 0 for r in found.collect() if not (r["text"] or "").strip())


def test_mixing_values(docs):
    """Rows of one id share their draw, rows without a word are kept, others by the probability of their cell."""
    for r in mixing.mixed(docs).collect():
        draw = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:8], 16) / 2**32
        assert r["__tokens"] == len((r["text"] or "").encode().split()) and r["__kept"] == (draw < r["__probability"])
        assert r["__probability"] == 1.0 if not r["__tokens"] else 0 < r["__probability"] <= 1


def test_near_duplicate_stage(spark, docs):
    """One row of each group stays: copies and near copies go to the smallest id, repeated rows stay once."""
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    texts = [(r[0], r[1]) for r in MORE]
    blank = {i for i, t in texts if not (t or "").split()}  # 1, 2, 3: no word
    assert sorted(own_id(r["doc_id"]) for r in kept.select("doc_id").collect() if r["doc_id"] in blank) == [1]
    assert [r["text"] for r in kept.where("doc_id in (4, 5)").collect()] == [LONG]
    # Three lines that differ in one of 21 words: similar enough to none, so all ids stay, the repeated row once.
    assert sorted(own_id(r["doc_id"]) for r in kept.where(F.col("text").contains("own line")).collect()) == [NULL_ID, 10, 11]


def test_pipeline_stages_by_hand(spark):
    """run() against the rules of each stage worked out in plain Python from the stage before (verdicts of the language
    model of stage one and draws of the mixture are taken from their operators, which tests of their own hold)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = corpus_pipeline.quality_stage(spark, docs, SF).collect()
    scored = {r["doc_id"]: r["kept"] for r in queries.op3_quality_rules(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in one} == {i for i, k in scored.items() if k} and not any(base(r["text"])[5] for r in one)
    holders = defaultdict(set)
    for r in one:
        for line in r["text"].split("\n"):
            holders[line.strip(" \t\x0b\x0c\r\n").encode().lower()].add(r["doc_id"])
    two = {}
    for r in one:
        lost = lambda x: len(x.decode()) >= 20 and len(holders[x]) >= 3 and r["doc_id"] != max(holders[x])  # noqa: B023, E731
        two[r["doc_id"]] = "\n".join(x for x in r["text"].split("\n") if not lost(x.strip(" \t\x0b\x0c\r\n").encode().lower()))
    sets = {}
    for i, t in two.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    low = {i: i for i in two}
    ids = sorted(two)
    for _ in range(6):
        for a in ids:
            for b in ids:
                if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    three = {i: two[i] for i in ids if low[i] == i}
    rows = spark.createDataFrame([(i, t, r["lang"], r["source"], len(t)) for r in one for i, t in [(r["doc_id"], two[r["doc_id"]])] if i in three], "doc_id long, text string, lang string, source string, n_chars long")
    four = {r["doc_id"] for r in mixing.mixed(rows).where("__kept").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == four and len(texts) > len(one) >= len(three) > len(four) > 0
    assert all(got[i][1] == hashlib.sha256(three[i].encode()).hexdigest() for i in four)


def test_a_family_right_at_the_limit():
    """2,000 members that all differ in 150 to 205 bits: links fewer than members, and none where no pair is similar."""
    rng = np.random.default_rng(3)
    n, lanes = 2000, shingles.LANES
    core = rng.integers(0, 2, lanes * 64, dtype=np.uint8)
    flips = np.stack([rng.permutation(lanes * 64) < 95 for _ in range(n)])
    bits = np.packbits(core ^ flips, axis=1).view(np.uint64)
    far = np.bitwise_count(bits[:50, None] ^ bits[None]).sum(2)
    assert np.median(far[far > 0]) < shingles.LIMIT
    base = np.arange(800, dtype=np.uint64)
    own = [np.sort(np.r_[base, 10_000 + 1000 * np.uint64(i) + np.arange(50, dtype=np.uint64)]) for i in range(n)]
    node = np.arange(n)
    found = shingles.group_links(node, node, np.zeros(n, int), bits, own, 0.8)
    assert len(found) <= n - 1 and len(set(sum(found, ()))) > 0.99 * n
    assert shingles.group_links(node[:200], node[:200], np.zeros(200, int), bits[:200], [np.r_[x, 10**7 + 1000 * np.uint64(i) + np.arange(100, dtype=np.uint64)] for i, x in enumerate(own[:200])], 0.8) == []
    half = np.arange(n) % 2
    across = shingles.group_links(node, node, half, bits, own, 0.8)
    assert len(across) <= n - 1 and all(half[u] != half[v] for u, v in across)


def test_toxicity_odd_rows(spark):
    """Null and empty texts have the score of zero features, repeated rows the same scores, and labels of the held-out fold
    and of the calibrating quarter do not reach the lexicon."""
    from ledgerloom.llm import toxicity

    rows = [(i, f"calm words number {i} here" if i % 3 else f"you vile fool {i} vile", int(i % 3 == 0)) for i in range(1, 400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "you vile fool"), (5, "you vile fool"), (5, "you vile fool"), (1002, "x " * 60_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (2000, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity_scores(docs, labels).collect()
    by = defaultdict(list)
    for r in found:
        by[r["id"]].append(r)
    assert len(found) == 405 and by[1000][0]["score"] == by[1001][0]["score"] and len(by[5]) == 3
    assert len({r["score"] for r in by[5]}) <= 2 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in found if r["id"] is not None)
    assert sum(by[i][0]["predicted"] == y for i, _, y in rows if i != 5) > 380
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0 and {r["score"] for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0.0}


def test_bpe_odd_rows(spark):
    """Ids and texts of every row as the public library gives them."""
    import base64

    import public_tokenizers
    import tiktoken

    from ledgerloom.llm import bpe

    with open(bpe.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, None), (2, ""), (3, "Grüße, 東京!  \n\n x"), (3, "Grüße, 東京!  \n\n x"), (None, "a" * 500 + " tail"), (4, "<|endoftext|>"), (5, "word " * 20_000)]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, id int, ids string")
    encoded = bpe.bpe_encode(d)
    want = sorted(((i, plain.encode_ordinary(t or "")) for i, t in rows), key=repr)
    assert sorted(((r["id"], list(r["ids"])) for r in encoded.collect()), key=repr) == want
    assert sorted(map(repr, (tuple(r) for r in bpe.bpe_decode(encoded).collect()))) == sorted(repr((i, t or "")) for i, t in rows)
