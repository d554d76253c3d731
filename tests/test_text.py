"""Text functions against known values and plain Python versions."""

import unicodedata

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platterkit.functions import similarity, text


def column(spark, values, *functions, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [tuple(r)[1:] for r in df.select("i", *[f(F.col("v")) for f in functions]).orderBy("i").collect()]


def plain_fold(s):
    for a, b in text.LETTER_FOLDS.items():
        s = s.replace(a, b)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    for a, b in text.DIGRAPH_FOLDS:
        s = s.replace(a, b)
    return s


def test_fold_agrees_with_plain_version_and_sql(spark):
    values = ["Kulør", "Müller", "Mueller", "Muller", "Ærø", "Straße", "ÉTÉ", "Þór", "blue", "Ｗｉｄｅ", "ﬁne ½", "Größe", "Żarnów", "Ёлка", "", "…", "é"]
    got = [r[0] for r in column(spark, values, text.fold)]
    assert got == [plain_fold(v) for v in values]
    assert got[1] == got[2] == got[3] == "muller"
    sql = [r[0] for r in duckdb.sql(f"select {text.fold_sql('v')} from (select unnest($v) v)", params={"v": values}).fetchall()]
    assert sql == got


def test_durations(spark):
    got = column(spark, ["8:49", "1:02:33", "0:30", "", None, "x", "3:x", " 2 : 05 "], text.parse_duration)
    assert [r[0] for r in got] == [529, 3753, 30, None, None, None, None, 125]
    assert [r[0] for r in column(spark, [529, 3753, None], text.format_duration, kind="int")] == ["8:49", "62:33", "unknown"]


def test_names_and_files(spark):
    assert column(spark, ["A (2), B (3)", "C (2) D"], text.strip_disambiguation) == [("A, B",), ("C (2) D",)]
    assert [r[0] for r in column(spark, ["/a/01 - Song.flac", "12_b.c.mp3", "1984.wav"], text.clean_filename)] == ["Song", "b.c", "1984"]
    assert column(spark, ['a/b:  c?"'], text.sanitize_filename) == [("a_b_ c__",)]
    assert [r[0] for r in column(spark, ["http://x/a.png?w=1", "http://x/a", "http://x.org/b/c.JPG"], text.url_extension)] == [".png", ".jpg", ".JPG"]
    assert [r[0] for r in column(spark, ["short", "long enough"], lambda c: text.truncate(c, 8))] == ["short", "long ..."]
    assert [r[0] for r in column(spark, ["日本", "abc", "Ａ"], text.has_cjk)] == [True, False, True]


def test_denoise(spark):
    df = spark.createDataFrame([("DJ X (a+b) - Song [1999] Original Mix", ["dj x (A+B)", "", None])], "t string, n array<string>")
    assert df.select(text.denoise(F.col("t"), F.col("n"))).first()[0] == "- Song [ ]"
    assert column(spark, ["- ! a", "ab"], text.has_content) == [(False,), (True,)]


def test_weighted_ratio_known_values():
    w = lambda a, b: similarity.weighted_ratio(similarity.process(a), similarity.process(b))
    assert round(w("Product (Original Mix)", "Tenth Chapter -  Product (Daydreamers Tonite At Noon Mix)"), 1) == 85.5
    assert round(w("Product (“Bedrock Dub” Mix)", "Tenth Chapter -  Product (Daydreamers Tonite At Noon Mix)"), 1) == 85.5
    assert w("Same Title", "same title") == 100
    assert w("", "x") == 0
    assert similarity.token_sort_ratio("b a", "a b") == 100


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_ratio_is_by_common_subsequence(a, b):
    assert similarity.ratio(a, b) == pytest.approx(200 * slow_common(a, b) / (len(a) + len(b)) if a or b else 100)
    assert 0 <= similarity.weighted_ratio(a.strip(), b.strip()) <= 100
