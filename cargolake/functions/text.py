"""Trimming, accent folding, keys and pattern matching, all as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Unicode white space; Spark's plain trim only knows the blank.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Texts that mean "no value", compared in lower case.
NULL_TOKENS = ("", "n/a", "na", "null", "none", "-", "nil")
COUNTRY_NULL_TOKENS = ("", "n/a", "na", "null", "none", "-")


def strip(c: Column) -> Column:
    """Text without white space at its ends. The usual value starts and ends with a visible ASCII
    character, which comparisons of bytes tell; only others meet the trim, which searches its list."""
    last = F.substring(c, -1, 1)
    edged = (c < "!") | (c >= "\u0080") | (last < "!") | (last >= "\u0080")
    return F.when(edged, F.btrim(c, F.lit(WHITESPACE))).otherwise(c)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_text(c: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """Trimmed text, NULL when it is only a stand-in for a missing value."""
    s = strip(c)
    longest = max(map(len, tokens))
    # No character gets shorter in lower case, so a longer text is none of them. One that becomes ASCII there
    # has three bytes at most: the count of bytes, which needs no look at the text, settles most.
    longer = (F.octet_length(s) > 3 * longest) | (F.char_length(s) > longest)
    return F.when(longer, s).otherwise(F.when(~F.lower(s).isin(*tokens), s))


def ascii_fold_text(text: str) -> str:
    """Driver-side accent fold of one search term."""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def key_text(text: str) -> str:
    """Driver-side search key of one term: folded, lower case, letters and digits only."""
    return re.sub(r"[^a-z0-9]", "", ascii_fold_text(text).lower())


#: First private code point: none of them folds to anything.
_PRIVATE = 0xE000


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """What every code point of Unicode folds to: single letters, and longer results."""
    single, longer = {}, {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        out = ascii_fold_text(chr(code))
        if len(out) == 1:
            single[chr(code)] = out
        elif out:
            longer[chr(code)] = out
    return "".join(single), "".join(single.values()), longer


def fold_accents(c: Column) -> Column:
    """ASCII form of a text: accents dropped, other non-ASCII characters removed.

    The same as compatibility decomposition of each character, for all of Unicode. Plain
    ASCII values, the usual case, take the first branch and cost one length check.
    """
    source, target, longer = _fold_tables()
    # Characters with longer results become placeholders of one range, so that no pattern or map
    # lists them all; placeholders already in the text go, as all private characters do.
    marks = "".join(chr(_PRIVATE + i) for i in range(len(longer)))
    translated = F.translate(c, source + "".join(longer) + marks, target + marks)
    mark = f"[{marks[0]}-{marks[-1]}]"
    results = F.array(*map(F.lit, longer.values()))

    def written(part: Column) -> Column:
        place = F.ascii(part) - F.lit(_PRIVATE)
        known = place.between(0, len(longer) - 1)
        return F.when(known, F.element_at(results, F.when(known, place + 1).otherwise(1))).otherwise(part)
    parts = F.split(translated, f"(?<={mark})|(?={mark})", -1)
    folded = F.regexp_replace(F.array_join(F.transform(parts, written), ""), r"[^\x00-\x7F]+", "")
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(folded)


def squash(c: Column) -> Column:
    """Lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def folded_key(c: Column) -> Column:
    return squash(fold_accents(c))


def like_pattern(text: str) -> str:
    """Spark treats a backslash as an escape in LIKE; here it stands for itself."""
    return text.replace("\\", "\\\\")


def contains(c: Column, text: str) -> Column:
    return c.ilike(like_pattern(f"%{text}%"))


def starts_with(c: Column, text: str) -> Column:
    return c.ilike(like_pattern(f"{text}%"))


def ends_with(c: Column, text: str) -> Column:
    return c.ilike(like_pattern(f"%{text}"))


def like(c: Column, text: str) -> Column:
    return c.like(like_pattern(f"%{text}%"))
