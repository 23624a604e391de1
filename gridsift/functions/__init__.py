"""Column functions: every one takes columns and returns a column."""

from gridsift.functions.parse import is_date, is_number, number_of, timestamp_of
from gridsift.functions.text import (
    brief_result,
    clean_text,
    contains_any,
    glob_to_regex,
    is_alpha_label,
    is_digit_label,
    is_header_word,
    match_glob,
    null_if_token,
    redact,
    redact_entry,
    strip,
    truncate,
)
from gridsift.functions.naming import file_stem, file_suffix, make_name, sanitize_name
from gridsift.functions.numbers import fixed, format_date, format_g6, format_number
from gridsift.functions.timing import backoff

__all__ = [
    "backoff", "brief_result", "clean_text", "contains_any", "file_stem", "file_suffix", "fixed", "format_date",
    "format_g6", "format_number", "glob_to_regex", "is_alpha_label", "is_date",
    "is_digit_label", "is_header_word", "is_number", "make_name", "match_glob",
    "null_if_token", "number_of", "redact", "redact_entry", "sanitize_name", "strip",
    "timestamp_of", "truncate",
]
