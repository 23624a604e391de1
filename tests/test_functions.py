from pyspark.sql import functions as F

from gridsift import functions as X
from gridsift.settings import RetrySettings


def one(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_numbers(spark):
    good = [" 7 ", "1e5", "+3", ".5", "5.", "-0.25", "\t8\n"]
    bad = ["1d", "1f", "NaN", "1_000", "$5", "- 5", "1,000", "5%", "0x1F", "1e400", "", "inf", "9" * 400]
    assert one(spark, good, X.is_number) == [True] * len(good)
    assert one(spark, bad, X.is_number) == [False] * len(bad)
    assert one(spark, good, X.number_of) == [7.0, 100000.0, 3.0, 0.5, 5.0, -0.25, 8.0]


def test_dates(spark):
    good = {
        "2024-01-15": "2024-01-15 00:00:00", "2024-01-15T10:30": "2024-01-15 10:30:00", "20240229": "2024-02-29 00:00:00",
        "2024": "2024-01-01 00:00:00", "2024/1/5": "2024-01-05 00:00:00", "1/15/2024": "2024-01-15 00:00:00",
        "15/1/2024": "2024-01-15 00:00:00", "1/2/2024": "2024-01-02 00:00:00", "Jan 15, 2024": "2024-01-15 00:00:00",
        " 2024-01-15 10:30:05.123 ": "2024-01-15 10:30:05", "5/2024/1": "", "2024-02-30": "", "1001": "",
        "2300-01-01": "", "T1": "", "10:30": "", "13/13/2024": "", "2024-01-15 25:00": "", "Foo 1, 2024": "",
    }
    assert one(spark, list(good), X.format_date) == list(good.values())


def test_format_number(spark):
    cases = {
        "007": "7", "+1.50": "1.5", "1e5": "100000", "-0.0": "-0", "1234567.10": "1234567.1", ".5": "0.5", "5.": "5",
        "1e-30": "1e-30", "12345678901234567890.12": "12345678901234567890.12", "abc": "", "100": "100", "0": "0",
    }
    assert one(spark, list(cases), X.format_number) == list(cases.values())
    assert one(spark, ["1234567", "0.1", "x", "1e5"], X.format_g6) == ["1.23457e+06", "0.1", "", "100000"]


def test_fixed_rounds_the_binary_value(spark):
    values = [i / 80 for i in range(0, 81)] + [i / 1600 for i in range(1, 1600, 7)] + [0.0005, 0.0015, 0.9995, 2.5, 12.25]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for row in df.select("v", X.fixed(F.col("v"), 3).alias("a"), X.fixed(F.col("v") * 100, 1).alias("b")).collect():
        assert row["a"] == f"{row['v']:.3f}" and row["b"] == f"{row['v'] * 100:.1f}"


def test_names(spark):
    cases = {
        'a<b>:"c': "a_b_c.csv", "__x__": "x.csv", "": "worksheet.csv", "...": "worksheet.csv", "a.CSV": "a.CSV",
        "a/b\\c|d?e*f": "a_b_c_d_e_f.csv", "z" * 250: "z" * 200 + ".csv", "y" * 250 + ".csv": "y" * 200 + ".csv",
        "a\tb": "a_b.csv", "v1.2": "v1.2.csv",
    }
    assert one(spark, list(cases), X.sanitize_name) == list(cases.values())
    stems = {"a.b.c": ("a.b", ".c"), ".hidden": (".hidden", ""), "plain": ("plain", ""), "..a.": ("..a", "."), "..": ("..", "")}
    assert one(spark, list(stems), X.file_stem) == [s for s, _ in stems.values()]
    assert one(spark, list(stems), X.file_suffix) == [s for _, s in stems.values()]

    def made(v):
        return X.make_name("{filename}_{worksheet}.csv", F.lit("book"), v)

    assert one(spark, ["Sheet 1!", "Été (2)", " x/y "], made) == ["book_Sheet 1.csv", "book_Été 2.csv", "book_xy.csv"]

    def stamped(v):
        return X.make_name("{filename}-{worksheet}", F.lit("b"), v, F.lit("T"))

    assert one(spark, ["s", "s.x"], stamped) == ["b-s_T.csv", "b-s_T.x"]


def test_labels_and_globs(spark):
    assert one(spark, ["Unit_Price", "été", "a1", "", "a-b c"], X.is_alpha_label) == [True, True, False, False, True]
    assert one(spark, ["1.2-3", "12", "1a", "-"], X.is_digit_label) == [True, True, False, False]
    assert one(spark, ["ID", "Name", "id2", "reference"], X.is_header_word) == [True, True, False, True]

    def globbed(v):
        return X.match_glob(v, ["*.XLSX", "data_[0-9]?.xls", "[!a]*.tmp"])

    names = ["a.xlsx", "A.XLSX", "a.xlsx.bak", "data_12.xls", "data_x2.xls", "b.tmp", "a.tmp", "axlsx"]
    assert one(spark, names, globbed) == [True, True, False, True, False, True, False, False]


def test_redaction(spark):
    assert one(spark, ["my Password", "key", "keys", "x" * 201], X.redact) == [
        X.text.REDACTED, X.text.REDACTED, "keys", "x" * 200 + "..."
    ]
    keys = ["api_key", "KEY", "keyboard", "auth_token", "plain"]
    assert one(spark, keys, lambda k: X.redact_entry(k, F.lit("v"))) == ["[REDACTED]", "[REDACTED]", "v", "[REDACTED]", "v"]


def test_clean_text(spark):
    assert one(spark, [None, " nan ", " x　", "nano"], X.clean_text) == ["", "", "x", "nano"]
    assert one(spark, ["NA", "N/A", " ", "null", "ok"], X.null_if_token) == [None, None, " ", None, "ok"]


def test_backoff(spark):
    retry = RetrySettings(delay=70.0)
    df = spark.range(-1, 6)
    plain = [r["s"] for r in df.select(X.backoff(F.col("id")).alias("s")).collect()]
    assert plain == [5.0, 5.0, 10.0, 20.0, 40.0, 60.0, 60.0]
    assert df.select(X.backoff(F.col("id"), retry).alias("s")).first()["s"] == 70.0


def test_cells_are_ruled_out_without_changing_what_is_a_number_or_date(spark):
    """The quick tests before the patterns drop nothing the patterns take, and plain cells meet no pattern at all."""
    from gridsift.functions import parse

    stems = [
        "2024", "1678", "2262", "20240229", "20240230", "2024-02-29", "2024-02-29T10:30:05.123", "2024/2/9", "2/9/2024", "Feb 9, 2024",
        "12.5", "-12.5", "+3", ".5", "5.", "1e5", "1e999", "12345", "123", "1999.", "3024-01-01", "word", "a,b", "a/b", "", "-", ".",
        "12:30", "99999999", "1-2", "\u0661\u0662", "\u20ac5", "10 20",
    ]
    signs = ["", " ", "\t", "\n", "\x0b", "\f", "\r", "  \t", "\x01", "\xa0", "!", "x"]
    rows = [(a + stem + b,) for stem in stems for a in signs for b in signs] + [(None,)]
    df = spark.createDataFrame(rows, "v string")
    v = F.col("v")
    wrong = ~parse._spelled_number(v).eqNullSafe(v.rlike(parse.NUMBER_RE)) | ~parse._spelled_date(v).eqNullSafe(v.rlike(parse.DATE_RE))
    assert df.where(wrong).collect() == []
    assert df.where(v.rlike(parse.DATE_RE)).count() > 200 and df.where(v.rlike(parse.NUMBER_RE)).count() > 200
