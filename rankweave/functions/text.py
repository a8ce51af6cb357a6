"""Text normalization as Column functions, all in the JVM.

White space and trimming follow ECMAScript's class, which is neither Java's ``\\s`` nor
Spark's ``trim``. Compatibility normalization (NFKC) has no SQL function; Spark ships
ICU, whose static composer takes a string and a flag, so it is reached by ``reflect``
and texts of ASCII only skip it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
# Characters that count as one, and edge punctuation of names.
_FROM = " " + "‐‑‒–—―−" + "‘’" + "“”"
_TO = " " + "-" * 7 + "''" + '""'
_EDGE = f"[{WS}.,;:!?()\\[\\]{{}}'\"“”‘’]"
_ACRONYM = f"^[\\p{{L}}\\p{{N}}.+/#\\-{WS}]+$"
ACRONYM_UNITS = 24


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def nfkc(c: Column | str) -> Column:
    """Unicode NFKC."""
    x = _col(c)
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    return F.when(x.rlike(r"^[\x00-\x7F]*$"), x).when(x.isNotNull(), composed)


def trim(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^[{WS}]+|[{WS}]+$", "")


def squeeze(c: Column | str) -> Column:
    """White space runs to one space, none at the edges; null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), f"[{WS}]+", " "))


def some(c: Column) -> Column:
    """Empty to null."""
    return F.nullif(c, F.lit(""))


def read_string(c: Column | str) -> Column:
    """Trimmed text, null if there is none."""
    return some(trim(_col(c).cast("string")))


def venue_name(c: Column | str) -> Column:
    """Key of a venue name. Null stays null."""
    x = F.lower(F.translate(nfkc(c), _FROM, _TO))
    x = F.regexp_replace(x, f"^{_EDGE}+|{_EDGE}+$", "")
    return F.trim(F.regexp_replace(x, f"[{WS}]+", " "))


def acronym_of_name(name: Column) -> Column:
    """Acronym key of an already normalized name, null if it can't be one."""
    units = F.octet_length(F.encode(name, "UTF-16BE")) / 2
    bare = F.replace(name, F.lit("."), F.lit(""))
    tokens = F.split(bare, " ", -1)
    initials = (F.size(tokens) > 1) & F.forall(tokens, lambda t: F.length(t) == 1)
    key = F.when(F.contains(name, F.lit(".")) & initials, F.array_join(tokens, "")).otherwise(bare)
    return F.when((name != "") & (units <= ACRONYM_UNITS) & name.rlike(_ACRONYM), key)


def venue_acronym(c: Column | str) -> Column:
    return acronym_of_name(venue_name(c))


def _letters(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")


def loose_name(c: Column | str) -> Column:
    """Letters and digits of the name key."""
    return _letters(venue_name(c))


def compact(c: Column | str) -> Column:
    """Letters and digits of the text, without the name rules."""
    return _letters(F.lower(nfkc(c)))


def issn_key(c: Column | str) -> Column:
    return F.regexp_replace(F.upper(nfkc(c)), "[^0-9X]", "")


def ordered_set(values: Column) -> Column:
    """Trimmed, non-empty, distinct, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(values, trim), lambda v: v.isNotNull() & (v != "")))


def optional_set(values: Column) -> Column:
    """``ordered_set``, null if empty."""
    out = ordered_set(values)
    return F.when(F.size(out) > 0, out)


def split_list(c: Column | str) -> Column:
    """Cell text to a list: split at ``|``, ``;`` or ``；``."""
    return ordered_set(F.split(F.coalesce(read_string(c), F.lit("")), "[|;；]", -1))


def and_variant(c: Column | str) -> Column:
    """The other spelling of ``and`` / ``&``; null if neither occurs."""
    x = _col(c)
    word = r"(?i)\band\b"
    return F.when(x.rlike(word), F.regexp_replace(x, word, "&")).when(F.contains(x, F.lit("&")), F.replace(x, F.lit("&"), F.lit("and")))


def number_text(c: Column | str) -> Column:
    """Integers without decimals, others rounded to four."""
    x = _col(c)
    short = F.regexp_replace(F.format_string("%.4f", x), r"\.?0+$", "")
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).when(x.isNotNull(), short)


def edition_text(c: Column | str) -> Column:
    x = _col(c)
    return F.when(x.isNotNull() & (x != ""), F.concat(F.lit("（"), x, F.lit("）"))).otherwise("")


# The same rules for short driver-side values (headers, configuration).

JS_SPACE = "\t\n\x0b\x0c\r                  　﻿"


_SPACES = re.compile(f"[{JS_SPACE}]+")


def py_trim(value: str) -> str:
    return value.strip(JS_SPACE)


def py_squeeze(value: str | None) -> str:
    return _SPACES.sub(" ", value).strip(" ") if value else ""


def header_key(value: str) -> str:
    text = py_trim(unicodedata.normalize("NFKC", value)).lower()
    return re.sub(f"[{JS_SPACE}_\\-()（）]", "", text)
