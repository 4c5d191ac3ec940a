"""Lenient typed reading of text: numbers, dates, countries, product codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from .text import COUNTRY_NULL_TOKENS, blank_to_null, clean_text

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Spellings of a country and the name they stand for.
COUNTRY_ALIASES = {
    "USA": "UNITED STATES",
    "U.S.A.": "UNITED STATES",
    "US": "UNITED STATES",
    "U.S.": "UNITED STATES",
    "AMERICA": "UNITED STATES",
    "UNITED STATES OF AMERICA": "UNITED STATES",
    "UK": "UNITED KINGDOM",
    "U.K.": "UNITED KINGDOM",
    "BRITAIN": "UNITED KINGDOM",
    "GREAT BRITAIN": "UNITED KINGDOM",
    "ENGLAND": "UNITED KINGDOM",
    "UAE": "UNITED ARAB EMIRATES",
    "U.A.E.": "UNITED ARAB EMIRATES",
    "KOREA": "SOUTH KOREA",
    "KOREA, REPUBLIC OF": "SOUTH KOREA",
    "REPUBLIC OF KOREA": "SOUTH KOREA",
    "PRC": "CHINA",
    "PEOPLES REPUBLIC OF CHINA": "CHINA",
    "HONGKONG": "HONG KONG",
    "VIETNAM": "VIET NAM",
    "RUSSIA": "RUSSIAN FEDERATION",
    "TAIWAN, PROVINCE OF CHINA": "TAIWAN",
    "CHINESE TAIPEI": "TAIWAN",
}


def lookup(mapping: dict[str, str], c: Column) -> Column:
    """Value of a short fixed mapping, NULL when the key is not in it."""
    return F.try_element_at(F.create_map(*(F.lit(v) for v in chain(*mapping.items()))), c)


def number(c: Column, thousands: bool = True) -> Column:
    """Double of a plain decimal text, NULL for anything else.

    The pattern is checked first because a Spark cast also accepts forms like ``12.5d``.
    """
    text = F.replace(c, F.lit(","), F.lit("")) if thousands else c
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def date(c: Column) -> Column:
    """Date of the forms customs extracts use; anything else is NULL.

    ``yyyyMM`` (first of the month), ISO with or without a time, day-first with ``-`` or
    ``/`` and an optional time, year-first with ``-`` or ``/``, and ``dd-Mon-yyyy`` or
    ``dd Mon yyyy``. Each step rewrites the text once, so the expression stays small
    enough for generated code; month names are only looked at when all else failed.
    """
    s = clean_text(c)
    plain = s
    for shape, form in (
        (r"^([0-9]{4})([0-9]{2})$", "$1-$2-1"),
        (r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$", "$1"),
        (r"(?s)^([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})[ T][0-9]{1,2}:[0-9]{2}.*$", "$1"),
        (r"^([0-9]{1,2})([-/])([0-9]{1,2})\2([0-9]{4})$", "$4-$3-$1"),
        (r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})$", "$1-$2-$3"),
    ):
        plain = F.regexp_replace(plain, shape, form)
    numeric = F.regexp_extract(plain, r"^((?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2})$", 1)
    named = F.regexp_replace(s, r"^([0-9]{1,2})\s+([A-Za-z]{3})\s+([0-9]{4})$", "$1-$2-$3")
    by_name = F.when(named.rlike("^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$"),
                     F.try_to_date(named, "d-MMM-yyyy"))
    return F.coalesce(numeric.try_cast("date"), by_name)


def country(c: Column) -> Column:
    name = F.upper(clean_text(c, COUNTRY_NULL_TOKENS))
    return F.coalesce(lookup(COUNTRY_ALIASES, name), name)


def hsn(c: Column) -> Column:
    """Digits of a product code, cut to the eight that all customs services share."""
    return blank_to_null(F.substring(F.regexp_replace(c, "[^0-9]", ""), 1, 8))


def chapter_of(code: Column) -> Column:
    digits = F.regexp_replace(code, "[^0-9]", "")
    return F.when(F.length(digits) >= 2, F.substring(digits, 1, 2))
