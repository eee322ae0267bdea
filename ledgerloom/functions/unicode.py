"""What Spark has no function for: composed accents and the full list of HTML character references.

Both are Arrow functions of the standard library, and both get null instead of every text that the built-in functions
settle, so only the few others are handed to Python.
"""

from __future__ import annotations

from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scalars import ENTITIES, unescape_html

#: No character below U+0300 is changed by composing.
COMPOSABLE = r"[^\x00-˿]"
#: References that unescape_html decodes as the standard does: its names (but for a few that have changed), and numbers from 160 on with few digits.
DECODED = r"&(?:" + "|".join(sorted(n[1:-1] for n, c in ENTITIES.items() if html5.get(n[1:]) == c)) + r"|#0*(?:1[6-9][0-9]|[2-9][0-9]{2}|[1-9][0-9]{3,4})|#[xX]0*(?:[aA-fF][0-9a-fA-F]|[1-9a-fA-F][0-9a-fA-F]{2,3}));"


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    import html

    return texts.map(lambda t: None if t is None else html.unescape(t))


def composed(x: Column) -> Column:
    """x in normal form C: a letter and its accents are one character where there is one."""
    some = F.coalesce(x.rlike(COMPOSABLE), F.lit(False))
    return F.when(some, _composed(F.when(some, x))).otherwise(x)


def unescape_all(x: Column) -> Column:
    """Character references decoded once, by the HTML standard: all names, also those that need no semicolon, and numbers."""
    some = F.coalesce(F.regexp_replace(x, DECODED, "").rlike("&[A-Za-z#]"), F.lit(False))
    return F.when(some, _unescaped(F.when(some, x))).otherwise(unescape_html(x))


def plain_note(x: Column) -> Column:
    """normalize_channel with all references and composed accents; for columns, not for members of arrays."""
    s = F.regexp_replace(F.regexp_replace(unescape_all(x), r"(?i)<br\s*/?>", "\n"), r"</?[^>]+>", " ")
    s = F.regexp_replace(F.regexp_replace(composed(s), r"\r\n?", "\n"), r"[\t ]+", " ")
    return F.regexp_replace(F.regexp_replace(s, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
