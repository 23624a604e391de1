"""Number and date formatting of delivered cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.functions import pandas_udf

from gridsift.functions.parse import is_number, number_of, plain_number, timestamp_of
from gridsift.functions.text import strip

# A number already in its shortest plain form needs no rewriting.
CANONICAL_RE = r"^-?(0|[1-9][0-9]*)(\.[0-9]*[1-9])?\z"


def _plain_decimal(text: Column) -> Column:
    """Drop a plus sign and the zeros that carry no value; no digit is lost."""
    out = F.regexp_replace(text, r"^\+", "")
    out = F.regexp_replace(out, r"^(-?)0+(?=[0-9])", "$1")
    out = F.regexp_replace(out, r"^(-?)\.", "$10.")
    out = F.regexp_replace(out, r"(\.[0-9]*?)0+\z", "$1")
    out = F.regexp_replace(out, r"\.\z", "")
    return F.when(text.rlike(CANONICAL_RE), text).otherwise(out)


def format_number(text: Column) -> Column:
    """Lossless plain decimal text of a number cell; any other cell becomes empty.

    Exponent forms are written out when an exact decimal exists, else left alone.
    """
    trimmed = strip(text)
    value = number_of(text)
    spelled = trimmed.try_cast("decimal(38,18)")
    exact = spelled.cast("double") == value
    written = F.when(exact, _plain_decimal(spelled.cast("decimal(38,18)").cast("string"))).otherwise(trimmed)
    plain = F.when(F.lower(trimmed).contains("e"), written).otherwise(_plain_decimal(trimmed))
    # Most cells at most lose zeros behind the dot.
    starts = ~text.startswith("0") & ~text.startswith("-0") | text.startswith("0.") | text.startswith("-0.")
    ready = plain_number(text) & starts & ~text.startswith(".") & ~text.startswith("-.")
    shorter = F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
    return F.when(ready, shorter).when(is_number(text), plain).otherwise(F.lit(""))


@pandas_udf(T.StringType())
def _six_digits(values: pd.Series) -> pd.Series:
    return values.map(lambda x: "" if pd.isna(x) else f"{x:g}")


def fixed(value: Column, digits: int) -> Column:
    """A non-negative double with a fixed number of decimals, as C and Python print it.

    ``format_string`` rounds the shortest decimal form half up; here the exact binary
    value is rounded, half to even.  The value is split in two halves whose products
    are exact, so that a near tie is told from a true one.
    """
    scale = 10**digits
    guess = F.floor(value * scale + 0.5)
    spread = value * 134217729.0
    high = spread - (spread - value)
    low = value - high
    above = (high * (2 * scale) - (guess * 2 - 1)) + low * (2 * scale)
    units = F.when((above > 0) | ((above == 0) & (guess % 2 == 0)), guess).otherwise(guess - 1)
    whole = F.floor(units / scale).cast("string")
    return F.concat(whole, F.lit("."), F.lpad((units % scale).cast("string"), digits, "0"))


def format_g6(text: Column) -> Column:
    """Six significant digits (C ``%g``).  Lossy; offered for byte-compatible output.

    The JVM formatter rounds differently, so this one runs as an Arrow batch function.
    """
    return _six_digits(number_of(text))


def _fraction(digits: Column) -> Column:
    """Digits behind the dot as they are written: no zeros at the end, and no dot without digits."""
    kept = F.rtrim(digits, F.lit("0"))
    return F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("."), kept))


def plain_g6(text: Column) -> Column:
    """Six significant digits of a text that ``format_number`` made, null where only the exact binary value can tell.

    A text of up to six signs is its own result.  Up to 13 digits from 1 on are rounded as doubles: what is no tie
    lies further from one than the error of the double and of its product.  Left are ties in the seventh digit, longer
    texts, exponents, and fractions below 1 of more than four digits.
    """
    unsigned = F.ltrim(text, F.lit("-"))
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    whole = F.substring_index(unsigned, ".", 1)
    digits = F.replace(unsigned, F.lit("."), F.lit(""))
    width = F.length(whole)
    tie = F.rtrim(F.substring(digits, 7, 20), F.lit("0")) == "5"
    power = F.pow(F.lit(10.0), F.abs(width - 6).cast("double"))
    value = unsigned.try_cast("double")
    rounded = F.rint(F.when(width <= 6, value * power).otherwise(value / power)).cast("long")
    signs = rounded.cast("string")
    # A carry (999999.7) makes seven digits: the first six say the same, one place up.
    carry = (rounded >= 1000000).cast("int")
    places = width + carry
    fixed_point = F.concat(sign, F.substr(signs, F.lit(1), places), _fraction(F.substr(signs, places + 1, F.lit(7))))
    exponent = F.concat(
        sign, F.substring(signs, 1, 1), _fraction(F.substring(signs, 2, 5)), F.lit("e+"), F.lpad((places - 1).cast("string"), 2, "0")
    )
    plain = ~text.contains("e") & ~text.contains("E")
    settled = (F.length(digits) <= 13) & (unsigned >= "1") & ~tie
    short = F.length(digits) <= 6
    return (
        F.when(plain & ((F.length(text) <= 6) | (short & (unsigned >= "1"))), text)
        .when(plain & settled, F.when(places <= 6, fixed_point).otherwise(exponent))
    )


# Cells that go to Python travel as one text a row.  For lists Spark measures the whole batch again with every row it adds.
_BETWEEN = "|"


@arrow_udf(T.StringType())
def _six_digit_rows(rows: pa.Array) -> pa.Array:
    if rows.null_count == len(rows):
        return rows
    said = (row and row.split(_BETWEEN) for row in rows.to_pylist())
    return pa.array([cells and _BETWEEN.join(text and f"{float(text):g}" for text in cells) for cells in said], pa.string())


def _left_over(texts: Column) -> Column:
    """Texts that go to Python (null for the other cells) in one, or null for the whole row if there are none."""
    return F.when(F.exists(texts, lambda c: c.isNotNull()), F.array_join(texts, _BETWEEN, ""))


def g6_cells(cells: Column, kinds: Column) -> Column:
    """Rewrite the number cells of whole rows to six significant digits; only cells that no plain rule settles go to Python."""
    plain = F.zip_with(cells, kinds, lambda c, k: F.when(k == "number", plain_g6(F.coalesce(c, F.lit("")))).otherwise(c))
    left = F.zip_with(cells, kinds, lambda c, k: F.when((k == "number") & plain_g6(c).isNull(), c))
    # A row of which nothing is left over has no list.
    done = F.split(_six_digit_rows(_left_over(left)), "[|]")
    return F.coalesce(F.zip_with(plain, done, lambda c, d: F.coalesce(c, d)), plain)


def g6_columns(
    rows: DataFrame, names: Sequence[str], kinds: Sequence[str], plain: Callable[[str], str]
) -> tuple[DataFrame, list[str]]:
    """``g6_cells`` of rows whose cells are columns of their own; returns the rows with the new columns, and their names.

    ``kinds`` and ``plain`` (``plain_g6``) are said in SQL.  A column that is known to hold other cells is left as it is.
    """
    some = [(n, k) for n, k in zip(names, kinds) if k not in ("'text'", "'date'")]
    if not some:
        return rows, list(names)
    settled = rows.selectExpr("*", *[f"CASE WHEN {k} = 'number' THEN {plain(n)} ELSE {n} END AS {n}_plain" for n, k in some])
    left = ", ".join(f"CASE WHEN {n}_plain IS NULL THEN {n} END" for n, _ in some)
    any_left = " OR ".join(f"{n}_plain IS NULL" for n, _ in some)
    packed = f"CASE WHEN {any_left} THEN array_join(array({left}), '{_BETWEEN}', '') END"
    done = settled.withColumn("_done", _six_digit_rows(F.expr(packed)))
    out = {n: f"{n}_g6" for n, _ in some}
    told = [f"coalesce({n}_plain, get(split(_done, '[|]'), {i})) AS {out[n]}" for i, (n, _) in enumerate(some)]
    return done.selectExpr("*", *told), [out.get(n, n) for n in names]


def format_date(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in any session zone; a cell that is no date becomes empty."""
    return F.coalesce(F.substring(timestamp_of(text).cast("string"), 1, 19), F.lit(""))
