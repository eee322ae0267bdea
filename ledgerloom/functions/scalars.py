"""Column functions for money, dates, hashes and texts; all run in the JVM."""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Currency spellings (fixed values).
CURRENCIES = {"CZK": "CZK", "KČ": "CZK", "KC": "CZK", "EUR": "EUR", "€": "EUR"}
#: Czech month names, nominative and genitive (fixed values).
MONTHS = {"leden": 1, "ledna": 1, "únor": 2, "února": 2, "březen": 3, "března": 3, "duben": 4, "dubna": 4, "květen": 5, "května": 5, "červen": 6, "června": 6, "červenec": 7, "července": 7, "srpen": 8, "srpna": 8, "září": 9, "říjen": 10, "října": 10, "listopad": 11, "listopadu": 11, "prosinec": 12, "prosince": 12}
ACCENTED, PLAIN = "áčďéěíňóřšťúůýžäöüßñèêàâçîôûëï", "acdeeinorstuuyzaousneeaaciouei"


def normalize_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def parse_decimal(x: Column) -> Column:
    """Amount text as DECIMAL(20, 6): spaces, apostrophes and currency tokens go, brackets negate, the last sign of , and . is the point."""
    s = F.regexp_replace(F.upper(x), r"[\s\u00A0\u202F']|CZK|EUR|KČ|KC|€", "")
    negative = s.rlike(r"^\(.*\)$")
    s = F.regexp_replace(s, r"[()]", "")
    comma, dot = F.locate(",", F.reverse(s)), F.locate(".", F.reverse(s))
    both = F.when(comma < dot, F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(s, ",", ""))
    s = F.when((comma > 0) & (dot > 0), both).otherwise(F.regexp_replace(s, ",", "."))
    value = s.try_cast("decimal(20,6)")
    return F.when(negative, -value).otherwise(value)


def to_minor(x: Column) -> Column:
    """Minor units of a decimal, rounded half up to two places."""
    return (F.round(x.cast("decimal(20,6)"), 2) * 100).cast("bigint")


def from_minor(x: Column) -> Column:
    return (x.cast("decimal(20,0)") / 100).cast("decimal(20,2)")


def normalize_currency(x: Column) -> Column:
    """ISO code of a spelling; null for an unknown one."""
    key = F.upper(F.trim(x))
    return reduce(lambda w, kv: w.when(key == kv[0], kv[1]), list(CURRENCIES.items())[1:], F.when(key == "CZK", "CZK"))


def format_money(minor: Column, currency: Column) -> Column:
    """1 916,95 € with no-break spaces and a decimal comma."""
    text = F.translate(F.format_number(from_minor(minor), 2), ",.", " ,")
    return F.concat(text, F.lit(" "), F.when(currency == "EUR", "€").when(currency == "CZK", "Kč").otherwise(currency))


def parse_czech_date(x: Column) -> Column:
    s = normalize_text(x)
    tight = F.regexp_replace(s, r"\s", "")
    m = F.regexp_extract(s, r"^\d{1,2}\. ?(\p{L}+) \d{4}$", 1)
    month = F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(v) for kv in MONTHS.items() for v in kv]), lambda k, _: k == F.lower(m))), F.lit(0))
    named = F.try_to_date(F.concat_ws(".", F.regexp_extract(s, r"^(\d{1,2})", 1), month.cast("string"), F.regexp_extract(s, r"(\d{4})$", 1)), "d.M.yyyy")
    numeric = [F.when(tight.rlike(p), F.try_to_date(tight, f)) for p, f in ((r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"), (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"))]
    return F.coalesce(*numeric, F.when(m != "", named))


def parse_datetime(x: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in ("dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")])


#: RFC 3339 texts: a date, perhaps a time with up to six digits of a second, perhaps a zone.
RFC_3339 = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"


def parse_timestamp(x: Column) -> Column:
    """Instant of an RFC 3339 text, in UTC where it names no zone; null where it is null, empty or no such text."""
    s = F.trim(x)
    full = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(s, F.lit("T00:00:00Z"))).when(s.rlike(r"(Z|[+-]\d{2}:\d{2})$"), s).otherwise(F.concat(s, F.lit("Z")))
    return F.when(s.rlike(RFC_3339), full.try_cast("timestamp"))


def normalize_paid(paid: Column, payed: Column) -> Column:
    """The instant of payment under two spellings: the earlier of two within a millisecond, else the first that there is."""
    a, b = parse_timestamp(paid), parse_timestamp(payed)
    near = F.abs(F.unix_micros(a) - F.unix_micros(b)) < 1000
    return F.when(near, F.least(a, b)).otherwise(F.coalesce(a, b))


def normalize_internal_code(x: Column) -> Column:
    return F.regexp_replace(x, r"^(-*\d+)\.0$", "$1")


def sha256_text(*parts: Column) -> Column:
    """SHA-256 of the parts joined by |; a null part is empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(normalize_text(p.cast("string")), F.lit("")) for p in parts]), 256)


def booking_keys(payment: Column, reservation: Column, currency: Column, minor: Column, payout: Column, arrival: Column, departure: Column, invoice_type: Column, status: Column) -> dict[str, Column]:
    """natural_key of the payout, row_hash of the line and source_identity of what it pays."""
    day = payout.cast("string")
    return {
        "natural_key": sha256_text(payment, day, currency),
        "row_hash": sha256_text(payment, reservation, currency, minor, day, arrival.cast("string"), departure.cast("string"), invoice_type, status),
        "source_identity": sha256_text(payment, reservation, currency, day, invoice_type),
    }


def reservation_group_id(code: Column, reference: Column) -> Column:
    """Group of the reservations that share an internal code and a reference (null: empty)."""
    return F.sha2(F.concat(F.coalesce(code, F.lit("")), F.lit("|"), F.coalesce(reference, F.lit(""))), 256)


def canonical_json(**cols: Column) -> Column:
    """Compact JSON with sorted keys and nulls kept."""
    return F.to_json(F.struct(*[cols[k].alias(k) for k in sorted(cols)]), {"ignoreNullFields": "false"})


#: HTML entities that have a name, from the standard library; numeric ones are worked out.
ENTITIES = {f"&{name};": chr(code) for name, code in name2codepoint.items()} | {"&apos;": "'"}
ENTITY = r"(&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});)"


def unescape_html(x: Column) -> Column:
    """Character references decoded once: named ones of ENTITIES and numeric ones; others stay."""
    names = F.create_map(*[F.lit(v) for kv in ENTITIES.items() for v in kv])

    def decoded(e: Column) -> Column:
        body = F.substring(e, 3, 40)
        code = F.when(F.lower(F.substring(e, 3, 1)) == "x", F.conv(F.regexp_replace(body, "[xX;]", ""), 16, 10)).otherwise(F.regexp_replace(body, ";", "")).cast("int")
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.when(e.startswith("&#"), sign).otherwise(F.coalesce(F.try_element_at(names, e), e))

    pieces = F.zip_with(F.split(x, ENTITY, -1), F.regexp_extract_all(x, F.lit(ENTITY), F.lit(1)), lambda p, e: F.concat(p, F.coalesce(decoded(e), F.lit(""))))
    return F.when(x.contains("&"), F.array_join(pieces, "")).otherwise(x)


def normalize_channel(x: Column) -> Column:
    """Plain text of a note: references decoded, <br> a line end, tags a blank, blanks joined, at most one empty line."""
    s = F.regexp_replace(F.regexp_replace(unescape_html(x), r"(?i)<br\s*/?>", "\n"), r"</?[^>]+>", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"\r\n?", "\n"), r"[\t ]+", " ")
    return F.regexp_replace(F.regexp_replace(s, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


#: Labels and digits of a booking reference (fixed values).
REFERENCE = r"(?i)(Original\s*ID|Channel\s*reservation\s*id)\s*[:=]?\s*([0-9]{6,20})"
PARSER_VERSION = "1.1.0"


def booking_references(notes: Column) -> Column:
    """Distinct references over an array of notes, in order of appearance."""
    return F.array_distinct(F.flatten(F.transform(notes, lambda n: F.regexp_extract_all(normalize_channel(n), F.lit(REFERENCE), F.lit(2)))))


def reference_status(found: Column) -> Column:
    return F.when(F.size(found) == 0, "MISSING").when(F.size(found) == 1, "CONFIRMED").otherwise("CONFLICT")


#: Patterns of what must not be shown (fixed values): e-mail addresses, tokens by name, bearer tokens, JWT and API keys.
EMAIL = r"([\w.+-]+)@([\w.-]+)"
TOKENS = (r"(?i)(x-access-token|x-client-token|access[_ -]?token|client[_ -]?token|authorization)\s*[:=]\s*[^,;\s\"}]+", r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", r"\beyJ[A-Za-z0-9._-]{20,}\b", r"\bbh_[A-Za-z0-9._-]{20,}\b")
SENSITIVE_KEYS = r"(?i)(access.?token|client.?token|authorization|password|secret)"


def redact(x: Column) -> Column:
    """Card numbers keep 6 and 4 digits, e-mail addresses become ***@***, tokens [REDACTED]."""
    s = x
    for n in range(9, 2, -1):  # a replacement of the length of what it replaces, for each length
        s = F.regexp_replace(s, rf"(?<!\d)(\d{{6}})\d{{{n}}}(\d{{4}})(?!\d)", "$1" + "*" * n + "$2")
    s = F.regexp_replace(s, EMAIL, "***@***")
    for pattern in TOKENS:
        s = F.regexp_replace(s, pattern, "[REDACTED]")
    return s


def redact_map(x: Column) -> Column:
    """A map of texts: values under sensitive keys become ***, the others are redacted."""
    return F.transform_values(x, lambda k, v: F.when(k.rlike(SENSITIVE_KEYS), F.lit("***")).otherwise(redact(v)))


def date_points(days: Column, booking: Column) -> Column:
    """Points for a date distance: 5/3/1 for payouts, 25/18/10 for others, within 2, 4 and 7 days."""
    return F.when(booking, F.when(days <= 2, 5).when(days <= 4, 3).when(days <= 7, 1).otherwise(0)).otherwise(F.when(days <= 2, 25).when(days <= 4, 18).when(days <= 7, 10).otherwise(0))


def changed_fields(pairs: dict[str, tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(k)) for k, (a, b) in pairs.items()]))


def without_accents(x: Column) -> Column:
    return F.translate(F.lower(x), ACCENTED, PLAIN)


def csv_safe(x: Column) -> Column:
    return F.when(x.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


def reference_mentions(df: DataFrame, note: str) -> DataFrame:
    """A row for each mention in the normalised note: label, candidate, its start_at and end_at (from 0), the hash of the
    raw note and an id of hash, candidate, label, place and parser version. Offsets are running lengths of the pieces
    between matches."""
    rows = df.withColumn("__plain", normalize_channel(F.col(note)))
    rows = rows.withColumn("__between", F.split("__plain", REFERENCE, -1)).withColumn("__found", F.regexp_extract_all("__plain", F.lit(REFERENCE), F.lit(0)))
    lengths = lambda name, n: F.aggregate(F.slice(name, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    rows = rows.select(*df.columns, "__between", "__found", F.posexplode("__found").alias("__n", "__text"))
    end = lengths("__between", F.col("__n") + 1) + lengths("__found", F.col("__n") + 1)
    rows = rows.withColumn("label", F.regexp_extract("__text", REFERENCE, 1)).withColumn("candidate", F.regexp_extract("__text", REFERENCE, 2))
    rows = rows.withColumn("end_at", end).withColumn("start_at", F.col("end_at") - F.length("candidate")).withColumn("snapshot_hash", F.sha2(note, 256))
    own = F.sha2(F.concat_ws("|", "snapshot_hash", "candidate", "label", F.col("start_at").cast("string"), F.lit(PARSER_VERSION)), 256)
    return rows.withColumn("mention_id", own).drop("__between", "__found", "__n", "__text")


def redacted_preview(x: Column) -> Column:
    """Plain text with runs of three digits or more as at most eight bullets, e-mail addresses masked, 240 characters."""
    s = normalize_channel(x)
    for n in range(3, 8):
        s = F.regexp_replace(s, rf"(?<!\d)\d{{{n}}}(?!\d)", "•" * n)
    s = F.regexp_replace(s, r"(?<!\d)\d{8,}(?!\d)", "•" * 8)
    return F.left(F.regexp_replace(s, EMAIL, "•••@•••"), F.lit(240))


def resolved_references(rows: DataFrame) -> DataFrame:
    """(reservation, reference, status) from extractions with a decision: the first accepted one wins, else what is not rejected decides."""
    left = F.when(~F.col("decision").eqNullSafe("REJECT"), F.col("candidate"))
    per = rows.groupBy("reservation").agg(F.min(F.when(F.col("decision") == "ACCEPT", F.struct("extraction", "candidate"))).alias("a"), F.count_distinct(left).alias("n"), F.min(left).alias("one"))
    status = F.when(F.col("a").isNotNull() | (F.col("n") == 1), "MANUAL_CONFIRMED").when(F.col("n") > 1, "CONFLICT").otherwise("MISSING")
    return per.select("reservation", F.when(F.col("a").isNotNull(), F.col("a.candidate")).when(F.col("n") == 1, F.col("one")).alias("reference"), status.alias("status"))
