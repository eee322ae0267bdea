"""Ranked search, decontamination and token alignment against brute force, with awkward rows."""

import math
import random
import re
import string
from collections import Counter

import duckdb
import pytest

from ledgerloom.llm import align, decontam, lexical, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Extra columns with names that the operators use inside.
DOCS = "doc_id long, text string, id long, row long, hash long, n long, terms string, words string, item string, digest string"
ITEMS = "item_id long, text string, item string, hash long, words string, id long"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def table(spark, rows, schema):
    n = schema.count(",") - 1
    return spark.createDataFrame([(*r, *[None] * n) for r in rows], schema)


@pytest.fixture(scope="module")
def made():
    """Documents that hold parts of items: whole ones, one word short, twice in a row, at either end, in other case."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["ÜBER", "naïve", "Zwölf12"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    spans = [text(n) for n in (10, 25, 40, 12)] + [["unique", "short", "item"], ["lone"], text(9) + ["end"]]
    items = [(i, " ".join(x)) for i, x in enumerate(spans)] + [(None, "null item words " * 4), (7, None), (8, ""), (9, " ., "), (2, "another text for the second item with ten words or so"), (10, "a a a a a a a a a a a a a")]
    docs = [(None, None), (1, ""), (2, " .,\n"), (3, "lone"), (3, "lone"), (4, "x unique SHORT item, item"), (None, "null item words null item words null item words null"), (5, "a-a " * 40), (6, "w1 " * 25)]
    for i in range(60):
        own = text(rng.randrange(5, 60))
        for _ in range(rng.randrange(4)):
            part = rng.choice(spans)
            a = rng.randrange(len(part))
            at = rng.randrange(len(own) + 1)
            own[at:at] = part[a : a + rng.choice([3, 9, 10, 11, 30])]
        docs.append((100 + i, rng.choice([" ", "-", ", ", "\n"]).join(own).upper() if i % 3 else " ".join(own)))
    docs += [(300, " ".join(text(30_000) + spans[1])), (300, "same id, other text, lone"), (301, docs[-1][1])]
    return docs, items


def test_words(made):
    from ledgerloom.llm.words import Words, grams

    texts = [(t or "").encode() for _, t in made[0]]
    found = Words(texts)
    got = [[found.word(i).decode() for i in range(found.first[t], found.first[t + 1])] for t in range(len(texts))]
    assert got == [words(t) for _, t in made[0]]
    hashed, by_word = found.hashes().tolist(), {}
    for w, h in zip([w for own in got for w in own], hashed):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word) and len(grams(found.hashes()[:3], 5)) == 0


def test_contamination(spark, made):
    docs, items = made
    windows = {}
    for i, t in items:
        w = words(t)
        size = min(10, len(w))
        for k in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    want = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[k : k + size]))) is not None:
                    found |= own
                    hit |= set(range(k, k + size))
        want.append((i, len(w), len(hit), sorted(found), bool(hit)))
    got = [(r[0], r[1], r[2], list(r[3]), r[4]) for r in decontam.contamination(table(spark, docs, DOCS).repartition(3), table(spark, items, ITEMS)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(x[4] for x in want) > 30
    none = decontam.contamination(table(spark, docs, DOCS), table(spark, [], ITEMS)).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] for r in none)
    assert decontam.contamination(table(spark, [], DOCS), table(spark, items, ITEMS)).count() == 0


def test_a_full_map_loses_nothing(spark, made, monkeypatch):
    docs, items = (table(spark, x, s) for x, s in zip(made, (DOCS, ITEMS)))
    want = sorted(map(repr, decontam.contamination(docs, items).collect()))
    monkeypatch.setattr(decontam, "MAP_BITS", 1 << 15)
    assert sorted(map(repr, decontam.contamination(docs, items).collect())) == want


def ranking(docs, items, k):
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(words(t))
    out = []
    for item, own in terms.items():
        scores = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            scores.append((score, i))
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], -(2**63) if x[1] is None else x[1]))[:k]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k, block, groups", [(50, 1 << 16, 64), (5, 12, 1)])
def test_ranking(spark, made, monkeypatch, k, block, groups):
    """Also with blocks of few terms, groups one by one, and batches of 64 documents."""
    docs, items = made
    for name, value in (("TERMS_A_BLOCK", block), ("GROUPS", groups), ("CELLS", 1 if block < 99 else lexical.CELLS)):
        monkeypatch.setattr(lexical, name, value)
    got = [tuple(r) for r in lexical.ranked_search(table(spark, docs, DOCS).repartition(3), table(spark, items, ITEMS), k).collect()]
    assert sorted(got, key=repr) == ranking(docs, items, k)
    assert lexical.ranked_search(table(spark, [], DOCS), table(spark, items, ITEMS)).count() == 0
    assert lexical.ranked_search(table(spark, docs, DOCS), table(spark, [], ITEMS)).count() == 0


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_decontamination"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def plain_alignment(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = align.tokenizer_paths()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    alphabet, out, counts = align.byte_alphabet(), [], Counter()
    size_a = lambda i: bytes(alphabet[c] for c in a.id_to_token(i))
    size_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if re.fullmatch("<0x..>", b.id_to_piece(i)) else b.id_to_piece(i).replace("▁", " ").encode()
    for i, t in docs:
        sides, raw = [], (" " + (t or "")).encode()
        for ids, of in ((a.encode(" " + (t or ""), add_special_tokens=False).ids, size_a), (b.encode(t or ""), size_b)):
            at, own = 0, []
            for k in ids:
                own.append((at, at + len(of(k)), k))
                at += len(of(k))
            sides.append(own if b"".join(map(of, ids)) == raw and t else None)
        if None in sides:
            sides = [[], []]
        groups, last = [], 0
        for cut in sorted({x[1] for x in sides[0]} & {x[1] for x in sides[1]}):
            groups.append("|".join(",".join(str(k) for s, e, k in own if last <= s and e <= cut) for own in sides))
            last = cut
        links = Counter((x[2], y[2]) for x in sides[0] for y in sides[1] if max(x[0], y[0]) < min(x[1], y[1]))
        counts.update(links.keys())
        out.append((i, sides, groups, links))
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    import hashlib

    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(i, len(s[0]), len(s[1]), len(g), sum(c.values()), sum(n for p, n in c.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in c.items()), digest(g)) for i, s, g, c in out]


@pytest.mark.parametrize("head", [align.HEAD, 3])
def test_alignment(spark, made, head):
    """head 3: nearly all irregular pairs go through the joins."""
    texts = ["", None, " ", "  two  spaces\t\ttab", "<|endoftext|> <s> </s> <unk>", "naïve Straße 東京 🙂 ﬁ", "a" * 3000, "\u0000\u0001", "é", "▁x", "x " * 500]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "repeat"), (3, "repeat"), (None, "null id")] + [d for d in made[0] if len(d[1] or "") < 3000]
    want = plain_alignment(docs)
    got = [tuple(r) for r in align.token_alignment(table(spark, docs, DOCS).repartition(3), head=head).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(x[1] == 0 for x in want) >= 2
    assert align.token_alignment(table(spark, [], DOCS)).count() == 0
