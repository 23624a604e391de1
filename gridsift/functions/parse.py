"""Lenient number and date parsing that never raises, whatever the session mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridsift.functions.text import strip

_WS = r"[ \t\n\x0B\f\r]*"
NUMBER_RE = "^" + _WS + r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?" + _WS + r"\z"

# The spellings of a date that count, before the calendar check.
# Years run from 1678 to 2261, the range of a 64-bit nanosecond clock.
_YEAR = "(16(7[89]|[89][0-9])|1[789][0-9]{2}|2[01][0-9]{2}|22([0-5][0-9]|6[01]))"
_CLOCK = r"([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?"
DATE_RE = (
    "^" + _WS + "("
    + _YEAR + "("
    "-[0-9]{2}-[0-9]{2}" + _CLOCK
    + "|[0-9]{4}|/[0-9]{1,2}/[0-9]{1,2})?"
    "|[0-9]{1,2}/[0-9]{1,2}/" + _YEAR
    + "|[A-Za-z]{3} [0-9]{1,2}, " + _YEAR
    + ")" + _WS + r"\z"
)


def _digits(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("-"), F.lit("")), F.lit("."), F.lit(""))


def plain_number(text: Column) -> Column:
    """Up to 18 digits, at most one dot, and at most a minus in front: what most numbers are, told without a pattern."""
    digits = _digits(text)
    # Digits and nothing else come back from a cast as they were; the 1 keeps the zeros in front.
    marked = F.concat(F.lit("1"), digits)
    others = F.octet_length(text) - F.octet_length(digits)
    allowed = text.startswith("-").cast("int") + text.contains(".").cast("int")
    return (others == allowed) & (digits != "") & F.coalesce(marked.try_cast("bigint").cast("string") == marked, F.lit(False))


def _spelled_number(text: Column) -> Column:
    """The spelling of a number.  What starts with a sign beyond the digits, as words do, needs no pattern."""
    return (text < ":") & text.rlike(NUMBER_RE)


def _spelled_date(text: Column) -> Column:
    """One of the spellings of a date.

    Most cells lack what all spellings of a kind have: a slash or comma, or a year in front (behind whitespace, which
    sorts before ``!``) and then a dash or nothing but 4 or 8 digits and whitespace.  They need no pattern.
    """
    before, behind = text < "!", F.substring(text, -1, 1) < "!"
    digits = ~text.contains(".") & (F.length(text).isin(4, 8) | before | behind)
    year = text.startswith("1") | text.startswith("2") | before
    likely = (year & (text.contains("-") | digits)) | text.contains("/") | text.contains(",")
    return likely & text.rlike(DATE_RE)


def number_of(text: Column) -> Column:
    """The value as a finite double, else null."""
    value = F.when(_spelled_number(text), strip(text).try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def is_number(text: Column) -> Column:
    """True or false, never null, so it can feed counts and ``when`` chains.

    Only a number with an exponent, or a very long one, can be too large for a
    double; all others are settled by their spelling.
    """
    short = ~text.contains("e") & ~text.contains("E") & (F.length(text) < 300)
    finite = F.abs(text.try_cast("double")) < F.lit(float("inf"))
    return F.when(_spelled_number(text), short | finite).otherwise(F.lit(False))


def timestamp_of(text: Column) -> Column:
    """The value as a timestamp without a zone if it is one of the fixed date spellings, else null.

    The time zone of the session plays no part.  Each value is judged on its own.  ``a/b/yyyy`` is month first, then day first.
    Spellings are brought to the ISO form, which the plain cast reads fastest; the
    cast also drops the whitespace the pattern allows.
    """
    slashed = r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"
    packed = r"([0-9]{4})([0-9]{2})([0-9]{2})"
    month_first = F.regexp_replace(text, slashed, "$3-$1-$2")
    iso = F.translate(F.regexp_replace(month_first, packed, "$1-$2-$3"), "/", "-")
    day_first = F.regexp_replace(text, slashed, "$3-$2-$1")
    kind = "timestamp_ntz"
    parsed = (
        F.when(text.contains("-"), text.try_cast(kind))
        .when(text.contains(","), F.try_to_date(strip(text), "MMM d, yyyy").cast(kind))
        .otherwise(F.coalesce(iso.try_cast(kind), day_first.try_cast(kind)))
    )
    return F.when(_spelled_date(text), parsed)


def is_date(text: Column) -> Column:
    return F.coalesce(timestamp_of(text).isNotNull(), F.lit(False))
