"""Text functions: trimming, empty markers, label tests, globs, redaction."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware trim removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Cell texts that stand for "no value".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Whole-cell header names that earn a bonus (any letter case).
HEADER_WORDS = (
    "id", "identifier", "key",
    "name", "title", "label",
    "date", "time", "timestamp",
    "value", "amount", "quantity", "count",
    "status", "state", "type", "category",
    "description", "notes", "comments",
    "code", "number", "ref", "reference",
)

# Words and key names whose values are hidden in logs.
SECRET_WORDS = ("password", "token", "secret")
REDACTED = "[REDACTED]"

HEADER_WORD_RE = r"(?i)^(" + "|".join(HEADER_WORDS) + r")\z"
ALPHA_RE = r"^\p{L}+\z"
DIGIT_RE = r"^\p{Nd}+\z"


def strip(text: Column) -> Column:
    """Trim every kind of whitespace, not just blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def null_if_token(text: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Null when the cell text is one of the empty markers (compared untrimmed)."""
    return F.when(~text.isin(*tokens), text)


def clean_text(text: Column) -> Column:
    """Trimmed text; null and a literal ``nan`` become the empty string."""
    trimmed = F.coalesce(strip(text), F.lit(""))
    return F.when(trimmed == "nan", F.lit("")).otherwise(trimmed)


def is_alpha_label(text: Column) -> Column:
    """Only letters once blanks, ``_`` and ``-`` are taken out."""
    return F.translate(text, " _-", "").rlike(ALPHA_RE)


def is_digit_label(text: Column) -> Column:
    """Only digits once ``.`` and ``-`` are taken out."""
    return F.translate(text, ".-", "").rlike(DIGIT_RE)


def is_header_word(text: Column) -> Column:
    return text.rlike(HEADER_WORD_RE)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Case-insensitive substring test against fixed plain words."""
    return F.lower(text).rlike("|".join(re.escape(word) for word in words))


def glob_to_regex(pattern: str) -> str:
    """Translate a shell glob (``* ? [..] [!..]``) to a whole-string regex."""
    out = []
    at = 0
    while at < len(pattern):
        char = pattern[at]
        at += 1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[" and "]" in pattern[at + 1:]:
            end = pattern.index("]", at + 1)
            body = pattern[at:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            negated = body.startswith("!")
            if negated:
                body = body[1:]
            elif body.startswith("^"):
                body = "\\" + body
            out.append(f"[{'^' if negated else ''}{body}]")
            at = end + 1
        else:
            out.append(re.escape(char))
    return "(?s)^" + "".join(out) + r"\z"


def match_glob(name: Column, patterns: Sequence[str]) -> Column:
    """True when the name matches any pattern, letter case aside."""
    tests = [F.lower(name).rlike(glob_to_regex(p.lower())) for p in patterns]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def truncate(text: Column, limit: int = 200) -> Column:
    """At most ``limit`` characters, marked with ``...`` when cut (log display form)."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def brief_result(result: Column) -> Column:
    """A function's result as it is logged: null stays null, more than 500 characters are cut."""
    return truncate(result.cast("string"), 500)


def redact(text: Column, limit: int = 200) -> Column:
    """A positional log value: hidden if it mentions a secret word or is ``key``."""
    hidden = contains_any(text, SECRET_WORDS) | (F.lower(text) == "key")
    return F.when(hidden, F.lit(REDACTED)).otherwise(truncate(text, limit))


def redact_entry(key: Column, text: Column, limit: int = 200) -> Column:
    """A named log value: hidden if its name has a secret word or ends in ``key``."""
    hidden = contains_any(key, SECRET_WORDS) | F.lower(key).endswith("key")
    return F.when(hidden, F.lit(REDACTED)).otherwise(truncate(text, limit))
