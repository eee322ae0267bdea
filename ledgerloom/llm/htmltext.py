"""Main text of web pages by deducing each host's template from equivalence classes of its tokens.

Tokens are elements (tags with their class or id, numbers of three digits and more as #) and the texts of whole blocks. A
token's occurrence vector, how often each page of its host has it, is kept as the sum of a hash for each page and count,
so tokens with equal sums occur alike and form a class; sums survive pages without an id and repeated ones, and add up
on the map side, so a host with a third of all pages is as many small rows as there are tasks. Pages are parsed twice.

The template is made of the classes that most pages support (elements found exactly once, texts) and, nested below them,
the classes that only some pages have but in which an element and the text directly under it occur alike: wherever the
element stands, it holds this text. The container is the article or main element with most of the text, else the
innermost element of the template that leaves no text of its host outside but links and named boilerplate. What is named
like boilerplate but holds most of the host's text is a wrapper around the container. Within the container names and tags
of boilerplate count whatever they hold, but for weak names (WEAK), which need links for half of their text. What is
returned are the slots: the container's blocks that are no template text, and headings with slots after them, which
belong to what they head. A page all of whose blocks are template text is a copy of others and keeps them.
"""

from __future__ import annotations

import html as html_lib
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|svg|title|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that end a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are no main text unless they hold much of it.
BOILERPLATE = frozenset("nav footer aside form button head header menu dialog".split())
NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side-?bar|nav\w*|menu|footer|header|masthead|breadcrumbs?|cookies?|consent|notices?|popup|modal|newsletter|subscribe|share|social|related|comments?|comment-?list|replies|disqus|login|search)(?:$|[\s_-])", re.I)
#: Names that say boilerplate within an article only where links are half of the text.
WEAK = re.compile(r"(?:header|masthead|related|search|share|social)", re.I)
#: Elements that say what follows them.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt th caption figcaption legend summary".split())
#: Elements and names that are never a wrapper around the main text, however much they hold.
NEVER_WRAPPER = r"^!<(?:(?:nav|aside|footer|menu|dialog|button)[ >]|[^>]*(?i:comment|replies|disqus))"
#: An article or main element is the container from this share of its host's text on; others must hold all of it.
MAIN_SHARE = 0.6
#: An element named like boilerplate that holds this share of its host's text is a wrapper.
WRAPPER_SHARE = 0.5
#: Tokens of the template are on this share of a host's pages.
MOST_PAGES = 0.8
#: Texts are template only on hosts with this many pages.
LEAST_PAGES = 5
#: Elements that can be the main text's own; a heading or a paragraph is never it, however often it comes.
SECTIONS = frozenset("article main section div td body html".split())
NUMBER = re.compile(r"[0-9]{3,}")


@lru_cache(1 << 16)
def opened(tag: str, attributes: str) -> tuple[str, bool]:
    """Token of an opening tag, and whether it or its name says boilerplate."""
    name = NUMBER.sub("#", " ".join(a or b or c for a, b, c in NAME.findall(attributes)).replace("\x1f", " ")) if attributes else ""
    return f"<{tag}{' ' + name if name else ''}>", tag in BOILERPLATE or bool(name and tag not in ("html", "body", "article", "main") and NAMED.search(name))


def parts(page: str):
    """('text', text), ('open', tag, token, boilerplate) and ('close', tag, token, False) in page order."""
    last = 0
    for m in TOKEN.finditer(page):
        if m.start() > last:
            yield ("text", page[last : m.start()], "", False)
        last = m.end()
        if m[3]:
            tag = m[3].lower()
            if m[2]:
                yield ("close", tag, f"</{tag}>", False)
            else:
                yield ("open", tag, *opened(tag, m[4]))
    if last < len(page):
        yield ("text", page[last:], "", False)


def weak(tag: str, token: str) -> bool:
    """Whether an element within an article that looks like boilerplate does so by a weak name only."""
    return tag == "header" and not NAMED.search(WEAK.sub("h", token[8:-1])) or tag not in BOILERPLATE and not NAMED.search(WEAK.sub("h", token[len(tag) + 2 : -1]))


def scan(page: str, mark: str = "") -> tuple[list, dict[str, int]]:
    """Blocks of text in page order, each a list of (path, text, whether in a link, whether in a heading), and how often
    each element comes.

    A path is the tokens of the open elements that can be a container or are boilerplate (these with !, the weak ones
    within an article with `mark`), each after \\x1f.
    """
    blocks, count, stack, block, path, link, heading, articles = [], {}, [], [], "", 0, 0, 0

    def end():
        if any(t.strip() for _, t, _, _ in block):
            blocks.append(block.copy())
        block.clear()

    for kind, tag, token, poor in parts(page):
        if kind == "text":
            block.append((path, tag, link > 0, heading > 0))
            continue
        if tag in BLOCKS:
            end()
        elif tag == "br":
            block.append((path, " ", link > 0, heading > 0))
        if kind == "open":
            if tag in VOID:
                continue
            stack.append((tag, path, link, heading, articles))
            link += tag == "a"
            heading += tag in HEADINGS
            slight = poor and articles > 0 and weak(tag, token)
            articles += tag in ("article", "main")
            if poor and not slight or tag in SECTIONS or slight and mark:
                count[token] = count.get(token, 0) + 1
                path = f"{path}\x1f{mark if slight else '!' if poor else ''}{token}"
        elif any(x[0] == tag for x in stack):
            while True:
                own, path, link, heading, articles = stack.pop()
                if own == tag:
                    break
    end()
    return blocks, count


def plain(text: str) -> str:
    return " ".join(html_lib.unescape(text).split())


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1


def shown(path: str, container: str | None, kept: frozenset, listed: frozenset) -> bool:
    """Whether text on the path is main text: under the container and under no boilerplate within it. Wrappers (kept) are
    none, but for within an article. listed: paths of weak elements that are lists of links."""
    if any(path == p or path.startswith(p + "\x1f") for p in listed):
        return False
    own = path.split("\x1f")[1:]
    if container is not None:
        bare = [x.lstrip("!?") for x in own]
        if container not in bare:
            return False
        own = own[bare.index(container) + 1 :]
        if re.match("<(?:article|main)[ >]", container):
            kept = frozenset()
    return not any(x[0] == "!" and x[1:] not in kept for x in own)


def link_lists(blocks: list) -> frozenset:
    """Paths of the weak elements half or more of whose text is in links."""
    held: dict[str, list[int]] = {}
    for block in blocks:
        for path, t, link, _ in block:
            at = path.find("\x1f?")
            while at >= 0:
                end = path.find("\x1f", at + 1)
                x = held.setdefault(path if end < 0 else path[:end], [0, 0])
                x[link] += len(t.strip())
                at = path.find("\x1f?", at + 1)
    return frozenset(p for p, (bare, linked) in held.items() if linked >= bare)


def main_text(page: str, container: str | None, kept: frozenset = frozenset(), lines: frozenset = frozenset()) -> str:
    """Blocks of text under the container's token (the whole page without one), joined by line ends.

    Boilerplate is left out, and blocks whose hash is in `lines` but for headings with other text after them; where all
    blocks are in `lines` the page is a copy and keeps them.
    """
    blocks, count = scan(page, "?")
    container, known, out = container if container in count else None, {}, []
    listed = link_lists(blocks)
    for block in blocks:
        for path, _, _, _ in block:
            if path not in known:
                known[path] = shown(path, container, kept, listed)
        under = [t for path, t, _, _ in block if known[path]]
        if not under:
            continue
        own = plain("".join(under))
        if own:
            whole = own if len(under) == len(block) else plain("".join(t for _, t, _, _ in block))
            out.append((own, bool(lines) and hash_of(whole) in lines, any(h for path, _, _, h in block if known[path])))
    last = max((k for k, (_, common, _) in enumerate(out) if not common), default=len(out))
    return "\n".join(own for k, (own, common, heading) in enumerate(out) if not common or last == len(out) or heading and k < last)


def occurs(page: int, n: int) -> int:
    """What a token that a page holds n times adds to its occurrence vector: 44 bits."""
    import xxhash

    return xxhash.xxh64_intdigest(f"{page} {n}") >> 20


def rows_of(page: str):
    """((kind, key, at), pages, pages with one, chars, vector, page) of 0 the page, 1 each element, 2 each block on each of its paths outside links."""
    blocks, count = scan(page)
    own = hash_of(page)
    yield (0, "", 0), 1, 1, 0, 0, own
    for token, n in count.items():
        yield (1, token, 0), 1, int(n == 1), 0, occurs(own, n), own
    texts, many = [], {}
    for block in blocks:
        texts.append(hash_of(plain("".join(t for _, t, _, _ in block))))
        many[texts[-1]] = many.get(texts[-1], 0) + 1
    for at, block in zip(texts, blocks):
        chars: dict[str, int] = {}
        for path, t, link, _ in block:
            chars[path] = chars.get(path, 0) + (0 if link else len(t.strip()))
        for path, n in chars.items():
            first = many.pop(at, 0)
            yield (2, path, at), int(first > 0), int(first == 1), n, occurs(own, first) if first else 0, own


TOKENS = "host string, kind int, key string, at long, n long, once long, chars long, vector long, low long, high long"


def _tokens(batches):
    import pyarrow as pa

    kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 7]
    for batch in batches:
        found: dict[tuple, list[int]] = {}
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for key, n, once, chars, vector, own in rows_of(page) if page else ():
                x = found.setdefault((name, *key), [0, 0, 0, 0, own, own])
                x[0] += n
                x[1] += once
                x[2] += chars
                x[3] += vector
                x[4], x[5] = min(x[4], own), max(x[5], own)
        cols = list(zip(*[(*k, *x) for k, x in found.items()])) or [[]] * 10
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [c.split()[0] for c in TOKENS.split(", ")])


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))


def token_classes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, kind, key, at, n, once, chars, vector, low, high): the rows of rows_of, summed; n and once are numbers of
    pages, low and high the least and greatest hash of these pages."""
    rows = pages.select(host(pages[url_col]).alias("host"), pages[html_col].alias("html"))
    sums = [F.sum(c).alias(c) for c in ("n", "once", "chars")] + [F.sum(F.col("vector").cast("decimal(20,0)")).alias("vector"), F.min("low").alias("low"), F.max("high").alias("high")]
    return rows.mapInArrow(_tokens, TOKENS).groupBy("host", "kind", "key", "at").agg(*sums)


def template_texts(classes: DataFrame, total: DataFrame) -> DataFrame:
    """(host, at): texts on most pages of a host of LEAST_PAGES pages at least, and texts in one class with the element
    directly around them, on as many pages that are not all the same."""
    blocks = classes.where("kind = 2")
    texts = blocks.groupBy("host", "at").agg(F.sum("n").alias("n"), F.sum("vector").alias("vector"), F.min("low").alias("low"), F.max("high").alias("high")).where(F.col("n") >= LEAST_PAGES)
    most = texts.join(total, "host").where(F.col("n") >= MOST_PAGES * F.col("all")).select("host", "at")
    around = blocks.select("host", "at", F.ltrim(F.element_at(F.split("key", "\x1f"), -1), F.lit("!")).alias("key")).distinct()
    elements = classes.where("kind = 1").select("host", "key", "vector")
    some = texts.where("low < high").join(around, ["host", "at"]).join(elements, ["host", "key", "vector"]).select("host", "at")
    return most.union(some).distinct()


def host_templates(classes: DataFrame) -> DataFrame:
    """(host, container, kept, lines): the token of the main text's element, null where the whole page counts, the tokens
    that are no boilerplate despite their names, and the hashes of template texts."""
    total = classes.where("kind = 0").select("host", F.col("n").alias("all"))
    once = classes.where("kind = 1").join(total, "host").where(F.col("once") >= MOST_PAGES * F.col("all")).select("host", F.col("key").alias("token"))
    blocks = classes.where("kind = 2")
    lines = written(template_texts(classes, total), "lines")
    own = blocks.join(lines.withColumn("common", F.lit(1)), ["host", "at"], "left").withColumn("slot", F.when(F.col("common").isNull(), F.col("chars")).otherwise(0))
    paths = written(own.groupBy("host", "key").agg(F.sum("chars").alias("chars"), F.sum("slot").alias("slot")), "paths")
    # Where all of a host's text is template, its pages are copies: then all of it counts.
    slots = paths.groupBy("host").agg((F.sum("slot") == 0).alias("copies"))
    paths = paths.join(slots, "host").withColumn("chars", F.when(F.col("copies"), F.col("chars")).otherwise(F.col("slot"))).where("chars > 0").select("host", "key", "chars")
    rows = paths.withColumn("own", F.slice(F.split("key", "\x1f"), 2, 10**6))
    poor = rows.select("host", "chars", F.explode(F.array_distinct(F.filter("own", lambda x: x.startswith("!")))).alias("token")).groupBy("host", "token").agg(F.sum("chars").alias("chars"))
    everything = rows.groupBy("host").agg(F.sum("chars").alias("everything"))
    wrappers = poor.join(everything, "host").where((F.col("chars") >= WRAPPER_SHARE * F.col("everything")) & ~F.col("token").rlike(NEVER_WRAPPER)).groupBy("host").agg(F.collect_set("token").alias("wrappers"))
    rows = rows.join(wrappers, "host", "left").withColumn("wrappers", F.coalesce("wrappers", F.array().cast("array<string>")))
    # Where the last boilerplate is on the path; -1 without any.
    bad = lambda x: x.startswith("!") & ~F.array_contains("wrappers", x)
    rows = rows.withColumn("last", F.array_max(F.concat(F.array(F.lit(-1)), F.transform("own", lambda x, i: F.when(bad(x), i).otherwise(-1)))))
    whole = rows.where("last < 0").groupBy("host").agg(F.sum("chars").alias("whole"))
    under = rows.select("host", "chars", "last", F.posexplode("own").alias("depth", "token")).where("depth > last")
    under = under.groupBy("host", F.ltrim("token", F.lit("!")).alias("token")).agg(F.sum("chars").alias("chars"), F.max("depth").alias("depth"))
    named = F.col("token").rlike(r"^<(?:article|main)[ >]") & (F.col("chars") >= MAIN_SHARE * F.coalesce("whole", F.lit(0)))
    good = under.where(F.regexp_extract("token", "^<([a-z]+)[ >]", 1).isin(*SECTIONS)).join(once, ["host", "token"]).join(whole, "host", "left").withColumn("named", named).where("named or chars = whole")
    best = total.join(good.groupBy("host").agg(F.max_by("token", F.struct("named", "chars", "depth")).alias("container")), "host", "left").select("host", "container")
    # Wrappers are kept around the main text only; within an article nothing named like boilerplate is.
    kept = wrappers.select("host", F.transform("wrappers", lambda x: F.substring(x, 2, 10**6)).alias("kept"))
    return best.join(kept, "host", "left").join(lines.groupBy("host").agg(F.collect_set("at").alias("lines")), "host", "left")


def _extracted(batches):
    import pyarrow as pa

    known = {}
    for batch in batches:
        texts = []
        for k, (name, page) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())):
            if name not in known:
                known[name] = (batch.column(4)[k].as_py(), *(frozenset(batch.column(c)[k].as_py() or ()) for c in (5, 6)))
            texts.append(main_text(page or "", *known[name]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    Null or empty html gives the empty text; a null url is a host of its own; rows that repeat an id each give a row;
    no rows give no rows; other columns are not looked at.
    """
    templates = written(host_templates(written(token_classes(pages, url_col, html_col), "classes")), "templates")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"), host(pages[url_col]).alias("host"))
    rows = rows.join(templates, "host", "left")
    return rows.select("page_id", "url", "html", "host", "container", "kept", "lines").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
