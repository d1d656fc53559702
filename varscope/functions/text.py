"""Text expressions: normal form, trimming, locale numbers, day-first dates."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column, functions as F

from varscope.functions.columns import PLAIN_NUMBER

EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


# --- Fixed values: where Hangul syllables and the letters that they are made of begin, and how many there are ---
HANGUL, LEADS, VOWELS, TAILS = 0xAC00, (0x1100, 19), (0x1161, 21), (0x11A7, 28)


@cache
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters with their bases, marks without, and the characters with more than one base.

    Derived for all scripts from canonical decomposition, applied to the end and without the marks it
    leaves; Hangul syllables are left to arithmetic.
    """
    folded, bases, marks, several = [], [], [], {}
    hangul = range(HANGUL, HANGUL + LEADS[1] * VOWELS[1] * TAILS[1])
    for code in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        letter = chr(code)
        if unicodedata.category(letter) == "Mn":
            marks.append(letter)
        elif unicodedata.decomposition(letter) and code not in hangul:
            base = "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn")
            if len(base) > 1:
                several[letter] = base
            elif base != letter:
                folded.append(letter)
                bases.append(base)
    return "".join(folded) + "".join(marks), "".join(bases), several


def fold_marks(text: Column) -> Column:
    """Canonical decomposition without its marks, in every script: what is left of ``é``, ``ά``, ``й``, ``ệ`` is the
    base letter, and Hangul syllables become their letters.

    Characters with one base are translated in one pass; the few with more, and Hangul, are looked for first.
    """
    folded, bases, several = _fold_tables()
    # Texts as tables: a literal each, where arrays and maps would be hundreds of expressions in every plan.
    letter_of = lambda block, place: F.substr(F.lit("".join(chr(block[0] + n) for n in range(block[1]))), place + 1, F.lit(1))
    more = F.str_to_map(F.lit("|".join(f"{a}={b}" for a, b in several.items())), F.lit("\\|"), F.lit("="))

    def taken_apart(letter: Column) -> Column:
        place = F.ascii(letter) - HANGUL
        tail = (place % TAILS[1]).cast("int")
        syllable = F.concat(letter_of(LEADS, F.floor(place / (VOWELS[1] * TAILS[1])).cast("int")),
                            letter_of(VOWELS, F.floor(place / TAILS[1]).cast("int") % VOWELS[1]),
                            F.when(tail > 0, letter_of(TAILS, tail)).otherwise(""))
        return F.when(letter.between(chr(HANGUL), chr(HANGUL + LEADS[1] * VOWELS[1] * TAILS[1] - 1)), syllable).otherwise(
            F.coalesce(F.try_element_at(more, letter), letter))

    rare = "".join(several) + f"{chr(HANGUL)}-{chr(HANGUL + LEADS[1] * VOWELS[1] * TAILS[1] - 1)}"
    apart = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1)), taken_apart), "")
    # One comparison a character tells most texts apart from those that may have such characters.
    first = min(map(ord, several))
    found = text.rlike(rf"[\x{{{first:X}}}-\x{{10FFFF}}]") & text.rlike(f"[{rare}]")
    return F.translate(F.when(found, apart).otherwise(text), folded, bases)


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends (SQL ``trim`` removes plain spaces only)."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def normalize(text: Column) -> Column:
    """Lower case without accents, runs of space, ``_`` and ``-`` as one space; null gives ''.

    Accents are looked for only in text that is not plain ASCII, which its byte length tells.
    """
    lower = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    letters = F.when(F.octet_length(lower) == F.length(lower), lower).otherwise(fold_marks(lower))
    return F.trim(F.regexp_replace(letters, r"(?U)[\s_\-\x1c-\x1f]+", " "))


def normalize_name(name: str) -> str:
    """The same normal form for a header, on the driver."""
    decomposed = unicodedata.normalize("NFD", name.strip().lower())
    bare = "".join(c for c in decomposed if unicodedata.category(c) != "Mn")
    return " ".join(bare.replace("_", " ").replace("-", " ").split())


# --- Fixed value: a number written with dots for thousands and a comma for decimals ------------
EUROPEAN = r"^-?\d{1,3}(\.\d{3})+(,\d+)?$|^-?\d+,\d+$"
# Every character that counts as white space, the no-break spaces included.
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def parse_number(text: Column) -> Column:
    """Number from ``1.234,56`` or ``1,234.56``; anything else is null. Decided per value."""
    packed = F.translate(text, WHITE_SPACE, "")
    english = F.translate(packed, ",", "")
    return F.when(packed.rlike(EUROPEAN), F.translate(packed, ",.", ".").try_cast("double")).when(
        english.rlike(PLAIN_NUMBER), english.try_cast("double"))


# Two shapes of date, with an optional time: year first, and day first. Each pattern also allows
# white space around the date, so that cells need not be trimmed first.
_TIME = r"(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)"
YEAR_FIRST = rf"(?U)^\s*(\d{{4}})([-/])(\d{{1,2}})\2(\d{{1,2}})(?:[ T]{_TIME})?\s*$"
DAY_FIRST = rf"(?U)^\s*(\d{{1,2}})([-/])(\d{{1,2}})\2(\d{{4}})(?: {_TIME})?\s*$"
DATE_MARK = r"[-/:]"


# --- Fixed value: month names, by their first three letters ----------------------------------
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# The less common shapes: two-digit years, month names, AM and PM, long fractions, a zone.
_MONTH = r"(?:[Jj]an(?:uary)?|[Ff]eb(?:ruary)?|[Mm]ar(?:ch)?|[Aa]pr(?:il)?|[Mm]ay|[Jj]une?|[Jj]uly?|[Aa]ug(?:ust)?" \
         r"|[Ss]ep(?:t(?:ember)?)?|[Oo]ct(?:ober)?|[Nn]ov(?:ember)?|[Dd]ec(?:ember)?)"
_ZONE = r"(?:\s*(Z|[+-]\d{2}:?\d{2}))?"
_CLOCK = rf"(?:[ T]+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:\.(\d+))?)?(?:\s*([AaPp][Mm]))?{_ZONE})?"
_ODD_DATES = (
    # (pattern, groups of year, month and day, whether a month that is none makes it the day)
    (rf"(?U)^\s*(\d{{4}})([-/])(\d{{1,2}})\2(\d{{1,2}}){_CLOCK}\s*$", (1, 3, 4), False),
    (rf"(?U)^\s*(\d{{1,2}})([-/])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_CLOCK}\s*$", (4, 3, 1), True),
    (rf"(?U)^\s*(\d{{1,2}})([-/ ])({_MONTH})\.?[-/ ,]+(\d{{4}}|\d{{2}}){_CLOCK}\s*$", (4, 3, 1), False),
    (rf"(?U)^\s*({_MONTH})(\.?)[-/ ](\d{{1,2}}),?[-/ ]+(\d{{4}}){_CLOCK}\s*$", (4, 1, 3), False),
)
_CLOCK_GROUPS = (5, 6, 7, 8, 9, 10)


def _odd_date(text: Column, pattern: str, groups: tuple[int, int, int], swap: bool) -> Column:
    """Moment of a text of one of the less common shapes; null where its parts are no date."""
    part = lambda n: F.regexp_extract(text, pattern, n)
    year, month, day = (part(n) for n in groups)
    number = year.try_cast("int")
    year = F.when(F.length(year) == 4, number).when(number <= 68, number + 2000).otherwise(number + 1900)
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.left(month, F.lit(3))))
    month, day = F.when(named > 0, named.cast("int")).otherwise(month.try_cast("int")), day.try_cast("int")
    hour, minute, second, fraction, half, zone = (part(n) for n in _CLOCK_GROUPS)
    h = F.coalesce(hour.try_cast("int"), F.lit(0))
    h = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(F.lower(half) == "pm", 12).otherwise(0))
    clock = F.format_string("%02d:%s:%s.%s", h, F.when(minute == "", "00").otherwise(minute),
                            F.when(second == "", "00").otherwise(second), F.rpad(F.left(fraction, F.lit(6)), 6, "0"))
    read = lambda m, d: F.when(h.isNotNull(), F.concat(
        F.format_string("%04d-%02d-%02d ", year, m, d), clock)).try_cast("timestamp_ntz")
    moment = F.coalesce(read(month, day), read(day, month)) if swap else read(month, day)
    # A zone moves the clock to UTC.
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.left(digits, F.lit(2)).try_cast("int") * 60 + F.right(digits, F.lit(2)).try_cast("int")
    shift = F.coalesce(F.when(F.startswith(zone, F.lit("-")), -minutes).otherwise(minutes), F.lit(0))
    return moment - F.make_dt_interval(mins=shift)


ODD_DATES = range(len(_ODD_DATES))


def odd_date(text: Column, shape: int) -> Column:
    """Timestamp of a date of one of the less common shapes; anything else is null."""
    pattern, groups, swap = _ODD_DATES[shape]
    return F.when(text.rlike(pattern), _odd_date(text, pattern, groups, swap))


def common_date(text: Column, year_first: Column | None = None, day_first: Column | None = None) -> Column:
    """Timestamp of a date of the two common shapes; anything else is null. The tests of the shapes may be given."""
    year_first = text.rlike(YEAR_FIRST) if year_first is None else year_first
    day_first = text.rlike(DAY_FIRST) if day_first is None else day_first

    def read(pattern: str, iso: str) -> Column:
        return F.regexp_replace(text, pattern, iso).try_cast("timestamp_ntz")

    return F.when(year_first, read(YEAR_FIRST, "$1-$3-$4 $5")).when(
        day_first, F.coalesce(read(DAY_FIRST, "$4-$3-$1 $5"), read(DAY_FIRST, "$4-$1-$3 $5")))


def in_common_shape(text: Column) -> Column:
    return text.rlike(YEAR_FIRST) | text.rlike(DAY_FIRST)


def parse_date(text: Column, odd: Iterable[int] = ODD_DATES) -> Column:
    """Timestamp without zone from a date with an optional time; anything else is null.

    Dates are year first or day first; where the day cannot come first (``03/15/2024``) the month
    does. Years may have two digits (69 to 99 are the last century's), months an English name,
    times AM or PM, and a zone is applied, which gives the moment in UTC. The common forms are
    rewritten to the ISO form, which the plain cast reads; the others are taken apart. ``odd`` names the less common
    shapes to look for: each makes the expression much longer, and a column has few of them.
    """
    found = F.when(in_common_shape(text), common_date(text))
    for shape in odd:
        pattern, groups, swap = _ODD_DATES[shape]
        found = found.when(text.rlike(pattern), _odd_date(text, pattern, groups, swap))
    return found


def reads_as_number(packed: Column) -> Column:
    """Whether :func:`parse_number` gives a number for a text, given without its white space."""
    return packed.rlike(EUROPEAN) | F.translate(packed, ",", "").rlike(PLAIN_NUMBER)


def natural_key(text: Column) -> Column:
    """Sort key in which digit runs compare as numbers (``b2`` before ``b10``).

    Each run loses its leading zeros and gets its length in front, as four digits.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    keyed = F.transform(
        pieces,
        lambda p: F.when(
            p.rlike(r"^\d"),
            F.concat(F.lpad(F.length(F.ltrim(p, F.lit("0"))).cast("string"), 4, "0"),
                     F.ltrim(p, F.lit("0"))),
        ).otherwise(p),
    )
    return F.concat_ws("", keyed)
