"""Main texts of generated pages: what is around and within the article in every size, on hosts of every size."""

import random

import pytest

from ledgerloom.llm import htmltext

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()
#: Boilerplate around and within an article: opening, closing.
OTHER = [
    ("<section class='comments'>", "</section>"), ("<div id='comment-list'><article class='comment'><p>", "</p></article></div>"), ("<aside>", "</aside>"), ("<div class='sidebar'>", "</div>"), ("<div class='advert box'>", "</div>"),
    ("<form action='/join' class='newsletter'>", "</form>"), ("<form>", "</form>"), ("<div class='notice'>", "</div>"), ("<div role='dialog' class='cookie-consent'>", "</div>"), ("<nav>", "</nav>"), ("<footer>", "</footer>"),
]


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(10_000)) for _ in range(n))


def page(rng, main, heads):
    """(html, main text): an article with shared sub-headings, and other elements of 5 to 60 % of it around and within."""
    n = rng.randrange(20, 120)
    out, kept = [], []

    def block(tag, text):
        out.append(f"<{tag}>{text}</{tag}>")
        kept.append(text)

    def other():
        opening, closing = rng.choice(OTHER)
        out.append(opening + words(rng, max(1, int(n * rng.uniform(0.05, 0.6)))) + closing)

    block("h1", words(rng, 5))
    for k in range(3):
        if heads:
            block("h2", ["Summary", "Method", "Results"][k])
        block("p", words(rng, n // 3))
        if rng.random() < 0.5:
            other()
        if k == 1 and rng.random() < 0.5:
            out.append("<div class='related work'>")
            block("p", words(rng, 8))
            out.append("</div>")
        if k == 1:
            out.append("<div class='related'>" + "".join(f"<a href='/{i}'>{words(rng, 3)}</a> " for i in range(4)) + "</div>")
    body, before, after = "".join(out), [], []
    for side in (before, after):
        out = []
        for _ in range(rng.randrange(3)):
            other()
        side += out
    return f"<html><body><header><h1>The Site</h1></header>{''.join(before)}<{main}>{body}</{main.split()[0]}>{''.join(after)}<footer>About us</footer></body></html>", "\n".join(kept)


@pytest.mark.parametrize("main", ["article", "main", "article class='post entry'"])
def test_generated_pages(spark, main):
    rng = random.Random(main)
    rows, want = [], {}
    for host, size in enumerate([1, 2, 4, 7, 60]):
        for _ in range(size):
            html, want[len(rows)] = page(rng, main, host % 2 == 0)
            rows.append((len(rows), f"http://h{host}.example/{len(rows)}", html))
    got = {r["page_id"]: r["text"] for r in htmltext.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert [i for i in want if got[i] != want[i]] == []


def test_constant_text(spark):
    """A disclaimer on every page goes even where it outweighs the text; headings stay where text follows them."""
    rows = [(i, "http://h/x", f"<article><p>three words {i}</p><h2>Method</h2><p>more {i}</p><h2>See also</h2><p>{'the same disclaimer ' * 20}</p></article>") for i in range(12)]
    got = [r["text"] for r in htmltext.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert got == [f"three words {i}\nMethod\nmore {i}" for i in range(12)]


def test_comments_outweigh(spark):
    """Reader comments after the article, each an article, hold most of the host's text."""
    rng = random.Random(1)
    rows, want = [], []
    for i in range(12):
        want.append(words(rng, 30))
        rows.append((i, "http://h/x", f"<body><article><p>{want[-1]}</p></article><section id='comments'>" + "".join(f"<article><p>{words(rng, 40)}</p></article>" for _ in range(3)) + "</section></body>"))
    got = [r["text"] for r in htmltext.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert got == want
