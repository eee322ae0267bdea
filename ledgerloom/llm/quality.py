"""Quality rules with a hashed n-gram log-likelihood ratio; DataFrame functions only.

Base rules look at one text. The model's verdict compares two multinomials over hashed uni- and bigrams of tokens (runs
of letters and digits, runs of other signs): that of trusted documents and that of all documents. A document's score
is the mean log ratio over its n-grams; documents under a fixed threshold are rejected. The table of log ratios has one
entry for each of BUCKETS buckets whatever the input, so it goes into the plan as a literal.

Texts of up to LONG characters are judged in place, with arrays of their words. Longer ones would fill an executor with
such arrays: they are cut into slices between words, which become rows; windows across two slices take the first two words
of the next one. What repeats is then found by grouping on (text, hashes of the window) with sums before the shuffle, and a
text's figures are sums over its slices. Both ways give the same figures. Columns that start with two underscores are this
module's own; an input that has one of those named in OWN raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import marked, table, written

BUCKETS = 1 << 14
THRESHOLD = -0.4
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Characters of a text that is judged in place, and of a slice of a longer one (more only for longer words or lines).
LONG, SLICE = 1 << 17, 1 << 13
#: A slice holds two words or more, unless it is the last.
WORD_SLICE = r"(?s)([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++.{0,%d}+[^\x20\x09-\x0D]*+|.++)" % SLICE
LINE_SLICE = r"(?s)(.{1,%d}+[^\n]*+)" % SLICE
#: Columns that this module makes for a while.
OWN = ["__q", "__score", "__kept", "__words", "__n", "__packed", "__at", "__windows", "__lines", "__tokens", "__buckets", "__text", "__sums", "__bucket", "__maybe"]


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def _position_bits(n: Column) -> Column:
    """Bits that hold a position below the bits of a window's hash."""
    return F.when(n <= 1 << 16, 16).when(n <= 1 << 20, 20).otherwise(28)


def _perhaps_repeated(n: Column, packed: Column) -> Column:
    """Positions of windows whose cut hash occurs twice or more: all that repeat, and by chance a few others.
    packed: sorted window hashes with the position in the low bits."""
    bits = _position_bits(n)
    same = lambda a, b: F.call_function("shiftright", a, bits) == F.call_function("shiftright", b, bits)
    twice = F.filter(packed, lambda x, k: same(x, F.get(packed, k - 1)) | same(x, F.get(packed, k + 1)))
    return F.transform(twice, lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int"))


def _repeat_words(windows: Column) -> Column:
    """Words in 3-word windows that occur twice or more. windows: sorted structs of the words themselves and the position."""
    same = lambda a, b: (a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"])
    twice = F.filter(windows, lambda x, k: same(x, F.get(windows, k - 1)) | same(x, F.get(windows, k + 1)))
    at = F.sort_array(F.transform(twice, lambda x: x["p"].cast("long")))
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(at, start, lambda acc, x: F.struct(x.alias("last"), (acc["sum"] + F.least(F.lit(3).cast("long"), x - acc["last"])).alias("sum")), lambda acc: acc["sum"])


def _checked(docs: DataFrame) -> None:
    clash = {c.lower() for c in docs.columns} & set(OWN)
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with this module's own")


def _is_long(text: Column) -> Column:
    return F.length(text) > LONG


def _short_rules(docs: DataFrame, text: Column) -> DataFrame:
    """docs, all of whose texts are short, with `__q`."""
    rows = docs.withColumn("__words", _found(text, WORD))
    n = F.size("__words").cast("long")
    rows = rows.withColumn("__n", n)
    words, n = F.col("__words"), F.col("__n")
    bits = _position_bits(n)
    hashed = lambda i: F.call_function("shiftleft", F.call_function("shiftright", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), bits), bits).bitwiseOR(i.cast("long"))
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n.cast("int") - 3), hashed)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("__packed", F.sort_array(windows))
    rows = rows.withColumn("__at", _perhaps_repeated(n, F.col("__packed")))
    rows = rows.withColumn("__windows", F.sort_array(F.transform("__at", lambda p: F.struct(F.get(words, p).alias("a"), F.get(words, p + 1).alias("b"), F.get(words, p + 2).alias("c"), p.alias("p")))))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    rows = rows.withColumn("__lines", lines)
    repeats = _repeat_words(F.col("__windows")).cast("long")
    rows = rows.withColumn("__q", F.struct(n.alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), repeats.alias("n_repeat_words")))
    return rows.drop("__words", "__n", "__packed", "__at", "__windows", "__lines")


def _digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _slices(long: DataFrame, text: Column, pattern: str) -> DataFrame:
    """(digest, i, slice): the slices of the different texts in order. Rows of slices are shuffled, not whole texts."""
    rows = long.select(_digest(text).alias("digest"), text.alias("text"))  # below the generator: once for each text
    rows = rows.select("digest", F.posexplode_outer(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("i", "slice"))
    return rows.dropDuplicates(["digest", "i"])


def long_slices(long: DataFrame, text: Column) -> DataFrame:
    """(digest, i, slice, rest): `rest` is what a window may need of the next slice, its first two words."""
    rows = written(_slices(long, text, WORD_SLICE), "slices")
    heads = rows.where("i > 0").select("digest", (F.col("i") - 1).alias("i"), F.regexp_extract("slice", r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){1,2}", 0).alias("rest"))
    return written(rows.join(heads, ["digest", "i"], "left").withColumn("rest", F.coalesce("rest", F.lit(""))), "slices")


def _long_figures(slices: DataFrame, long: DataFrame, text: Column, ratios: list[int] | None) -> DataFrame:
    """(__text, __q, and with ratios __sums) of the different long texts, __text being their digest."""
    words = slices.select("digest", "i", "slice", _found(F.col("slice"), WORD).alias("words"), _found(F.col("rest"), WORD).alias("more"))
    sums = words.groupBy("digest").agg(F.sum(F.size("words")).alias("n_words"), F.sum(F.length(F.array_join("words", ""))).alias("word_chars"), F.sum(F.regexp_count("slice", F.lit(SYMBOL))).cast("long").alias("n_symbols"))
    words = words.select("digest", "i", F.size("words").alias("n"), F.concat("words", "more").alias("words"))
    hashed = lambda seed, p: F.xxhash64(F.lit(seed), F.get("words", p), F.get("words", p + 1), F.get("words", p + 2))
    starts = F.when(F.size("words") >= 3, F.sequence(F.lit(0), F.least(F.col("n") - 1, F.size("words") - 3))).otherwise(F.array().cast("array<int>"))
    windows = words.select("digest", "i", "n", F.explode_outer(F.transform(starts, lambda p: F.struct(p.alias("p"), hashed(1, p).alias("h"), hashed(2, p).alias("g")))).alias("w")).select("digest", "i", "n", "w.*").where("p IS NOT NULL")
    windows = written(windows, "windows")
    twice = windows.groupBy("digest", "h", "g").agg(F.count("*").alias("times")).where("times > 1").select("digest", "h", "g")
    covered = windows.join(twice, ["digest", "h", "g"], "left_semi").select("digest", "i", "n", F.explode(F.array(*[F.col("p") + k for k in range(3)])).alias("p"))
    over = F.col("p") >= F.col("n")
    covered = covered.select("digest", F.when(over, F.col("i") + 1).otherwise(F.col("i")).alias("i"), F.when(over, F.col("p") - F.col("n")).otherwise(F.col("p")).alias("p")).distinct()
    repeats = covered.groupBy("digest").agg(F.count("*").alias("n_repeat_words"))
    lines = _slices(long, text, LINE_SLICE).select("digest", F.explode_outer(F.split("slice", "\n", -1)).alias("line")).where(F.col("line").rlike(WORD))
    lines = lines.select("digest", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(2), "line").alias("g")).groupBy("digest", "h", "g").agg((F.count("*") - 1).alias("more"))
    lines = lines.groupBy("digest").agg(F.sum("more").alias("n_dup_lines"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    found = sums.join(lines, "digest", "left").join(repeats, "digest", "left")
    kept = [F.col("digest").alias("__text"), F.struct("n_words", "word_chars", "n_symbols", zero("n_dup_lines"), zero("n_repeat_words")).alias("__q")]
    if ratios is not None:
        per = _sums(slices, F.col("slice"), F.col("rest"), ratios).groupBy("digest").agg(F.struct(F.sum("__sums.total").alias("total"), F.sum("__sums.n").alias("n")).alias("__sums"))
        found, kept = found.join(per, "digest"), [*kept, F.col("__sums")]
    return written(found.select(*kept), "long")


def _text(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def _parts(docs: DataFrame, text_col: str) -> tuple[Column, DataFrame, DataFrame]:
    _checked(docs)
    text = _text(docs, text_col)
    return text, docs.where(~_is_long(text)), docs.where(_is_long(text))


def _judged(docs: DataFrame, text_col: str, slices: DataFrame, ratios: list[int] | None) -> DataFrame:
    text, short, long = _parts(docs, text_col)
    rows = _short_rules(short, text)
    rows = rows if ratios is None else _sums(rows, text, F.lit(""), ratios)
    known = _long_figures(slices, long, text, ratios)
    rows = rows.unionByName(long.withColumn("__text", _digest(text)).join(known, "__text").drop("__text"))
    return rows.withColumn("__q", F.col("__q").withField("base_failed", (F.col("__q.n_words") < MIN_WORDS) | (100 * F.col("__q.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__q.n_words"))))


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed under `__q`."""
    text, _, long = _parts(docs, text_col)
    return _judged(docs, text_col, long_slices(long, text), None)


def _buckets(text: Column, rest: Column) -> tuple[Column, Column]:
    """(tokens, their uni- and bigrams' buckets) of a slice whose text goes on with rest; the buckets use `__tokens`."""
    tokens = F.col("__tokens")
    after = F.when(rest != "", F.regexp_extract(F.lower(rest), TOKEN, 0))
    one = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))
    two = F.transform(tokens, lambda t, i: F.pmod(F.xxhash64(t, F.coalesce(F.get(tokens, i + 1), after), F.lit(2)), F.lit(BUCKETS)).cast("int"))
    return _found(F.lower(text), TOKEN), F.concat(one, two)


def with_buckets(rows: DataFrame, text: Column, rest: Column) -> DataFrame:
    tokens, buckets = _buckets(text, rest)
    return rows.withColumn("__tokens", tokens).withColumn("__buckets", buckets).drop("__tokens")


def log_ratios(docs: DataFrame, trusted: DataFrame, slices: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """log(trusted / raw) of every bucket in millionths, each multinomial smoothed by one count a bucket. trusted: a column
    of ids; slices: the long texts'."""
    text, short, long = _parts(docs, text_col)
    ident = F.col(f"`{id_col}`").cast("long").alias("id")
    good = written(trusted.select(trusted[trusted.columns[0]].cast("long").alias("id")).where("id is not null").distinct(), "trusted")
    rows = with_buckets(marked(short.select(ident, text.alias("text")), good), F.col("text"), F.lit(""))
    rows = rows.select(F.lit(1).alias("raw"), F.col("marked").cast("int").alias("good"), F.explode_outer("__buckets").alias("bucket"))  # explode() would have its array worked out once more, in a filter below
    holders = marked(long.select(ident, _digest(text).alias("digest")), good)
    holders = holders.groupBy("digest").agg(F.count("*").alias("raw"), F.sum(F.col("marked").cast("int")).alias("good"))
    rows = rows.unionByName(with_buckets(slices.join(holders, "digest"), F.col("slice"), F.col("rest")).select("raw", "good", F.explode_outer("__buckets").alias("bucket")))
    counts = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).where("bucket is not null")
    # At most BUCKETS rows.
    found = {r["bucket"]: (r["raw"], r["good"]) for r in counts.collect()}
    raw, good = (sum(x[k] for x in found.values()) + BUCKETS for k in (0, 1))
    from math import log

    if good == BUCKETS:  # nothing is trusted: no evidence either way
        return [0] * BUCKETS
    none = (0, 0)
    return [round(1e6 * (log((found.get(b, none)[1] + 1) / good) - log((found.get(b, none)[0] + 1) / raw))) for b in range(BUCKETS)]


def _sums(rows: DataFrame, text: Column, rest: Column, ratios: list[int]) -> DataFrame:
    """rows with `__sums`: (total, n) of the ratios of their n-grams, whole numbers that add up alike in any order."""
    weights = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")  # folded to one literal
    rows = with_buckets(rows, text, rest)
    total = F.aggregate("__buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.get(weights, b))
    return rows.withColumn("__sums", F.struct(total.alias("total"), F.size("__buckets").cast("long").alias("n"))).drop("__buckets")


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with `__q` (see base_rules), `__score` (the mean log ratio of their n-grams, 0 without a token) and `__kept`.

    Null and empty texts have no words, fail the base rule and score 0. Rows that repeat an id are judged each by
    itself; a null id is never trusted. Texts of any length are whole. No rows give no rows; other columns pass through.
    """
    text, _, long = _parts(docs, text_col)
    slices = long_slices(long, text)
    rows = _judged(docs, text_col, slices, log_ratios(docs, trusted, slices, id_col, text_col))
    rows = rows.withColumn("__score", F.when(F.col("__sums.n") > 0, F.col("__sums.total") / 1e6 / F.col("__sums.n")).otherwise(0.0)).drop("__sums")
    return rows.withColumn("__kept", ~F.col("__q.base_failed") & (F.col("__score") >= threshold))


def trusted_ids(spark, sf_dir: str) -> DataFrame:
    """The trusted documents: those labelled as of good quality."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
