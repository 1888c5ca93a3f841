"""Text rules: normalisation, language tags, slugs, list cells."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "".join(chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
REMOVED = "​﻿­"
STRIPPED = r"[\t\n\x0B\f\r\x1C-\x20\x85]"


def _nfc(c: Column) -> Column:
    @F.pandas_udf("string")
    def nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return nfc(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{STRIPPED}+|{STRIPPED}+$", "")


def translated(c: Column) -> Column:
    """NFC, all space characters to U+0020, invisible characters out. ASCII text doesn't leave the JVM."""
    nfc = F.when(c.rlike(r"[^\x00-\x7F]"), _nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)
    return F.translate(nfc, SPACES + REMOVED, " " * len(SPACES))


def normalize(c: Column) -> Column:
    """The text as records hold it; null stays null, what is empty then is empty."""
    return strip(translated(c))


def optional(c: Column) -> Column:
    """Empty after normalisation is absent."""
    return F.nullif(normalize(c), F.lit(""))


def is_language_tag(c: Column) -> Column:
    return c.rlike("^[A-Za-z]{2,3}(-[A-Za-z0-9]{1,8})*$")


def is_slug(c: Column) -> Column:
    return c.rlike("^[a-z0-9]+([-_][a-z0-9]+)*$")


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def synonyms(c: Column) -> Column:
    """Comma-separated cell as an array, empties dropped."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def header(c: Column) -> Column:
    """Header key: first line, normalised, lower case."""
    return F.lower(normalize(F.split_part(c, F.lit("\n"), F.lit(1))))


def tagged(c: Column) -> Column:
    """A cell as (value, language): ``"v"@tag`` or ``"v"`` in Turtle's spelling, else the whole cell."""
    pattern = r'^\s*"([^"]*)"(?:@([A-Za-z0-9-]+))?\s*$'
    hit = c.rlike(pattern)
    return F.struct(
        F.when(hit, F.regexp_extract(c, pattern, 1)).otherwise(strip(c)).alias("value"),
        F.nullif(F.when(hit, F.regexp_extract(c, pattern, 2)), F.lit("")).alias("language"),
    )


def quoted_split(c: Column) -> Column:
    """Parts of a cell between semicolons outside quotes; a quote toggles, so an open one reaches to the end.

    Even-numbered parts of the text between quotes are outside: a semicolon there is a cut. Parts are stripped, empties dropped.
    """
    cut = "\u0001"
    pieces = F.transform(F.split(c, '"'), lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit(";"), F.lit(cut))).otherwise(x))
    return F.filter(F.transform(F.split(F.array_join(pieces, '"'), cut), strip), lambda x: x != "")


#: What full case folding makes of characters that lower case leaves otherwise.
_FOLDS = {x: x.casefold() for x in map(chr, range(sys.maxunicode + 1)) if x.casefold() != x.lower()}
_FOLDS |= {x.lower(): x.casefold() for x in map(chr, range(sys.maxunicode + 1)) if len(x.lower()) == 1 and x.lower() != x.casefold()}
_ONE = {a: b for a, b in _FOLDS.items() if len(b) == 1}
_MORE = {a: b for a, b in _FOLDS.items() if len(b) > 1}


def folded(c: Column) -> Column:
    """Case-folded text, for comparisons that ignore case: sharp s is ss, a final sigma a sigma, a ligature its letters."""
    c = F.translate(F.lower(c), "".join(_ONE), "".join(_ONE.values()))
    more = c
    for a, b in _MORE.items():
        more = F.replace(more, F.lit(a), F.lit(b))
    return F.when(c.rlike("[" + "".join(_MORE) + "]"), more).otherwise(c)
