import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import paths, width
from quire.functions import text as X


def values(spark, inputs, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (X.str_trim, [(" \t a b \v\f\r\n", "a b"), ("", ""), ("\xa0a", "\xa0a")]),
    (X.path_dirname, [("a/b/c.txt", "a/b"), ("c.txt", ""), ("/c", "")]),
    (X.path_normalize, [("a/./b//c", "a/b/c"), ("../../x", "x"), ("/a/../../b/", "/b"), ("", ""), ("a/b/..", "a")]),
    (X.url_decode, [("a%20b+c", "a b c"), ("100%", "100%"), ("a%zz", "a%zz"), ("%C3%A9", "é"), ("%%41", "%A")]),
    (X.url_path, [("a#b#c", "a"), ("a", "a"), ("#x", "")]),
    (X.url_fragment, [("a#b#c", "b#c"), ("a", None), ("a#", "")]),
    (X.words, [(" a\xa0b\tc\v ", ["a", "b", "c\v"]), ("", []), ("  ", [])]),
    (X.normalized_text, [("The  Iliad, é—Book I!", "the iliad book i"), ("Глава", "")]),
    (X.leading_digits, [("57.", "57"), ("a1", ""), ("", "")]),
    (X.is_digits, [("57", True), ("1,234", True), ("12345", False), ("-", False), ("5a", False), ("1984.", True)]),
    (X.normalize_title, [(" A \t b...\n", "A b…"), ("é" * 200, "é" * 127)]),
    (X.is_junk_title, [("INDEX", True), ("", True), (None, True), ("Indices", False), ("←", True)]),
    (lambda x: F.round(X.css_size(x).cast("double"), 4), [("20px", 1.25), ("18pt", 1.5), ("150%", 1.5), ("large", 1.2), ("9em", 5.0), ("0", None), ("abc", None), (" 1.25EM ", 1.25), ("-2em", None), ("2q", None), (".5", 0.5), ("1cm", 2.3622)]),
    (lambda x: F.concat_ws(":", X.css_selector(x)["kind"], X.css_selector(x)["key"]), [("p", "TAG:p"), ("div > .Note", "CLASS:note"), ("#main p", "TAG:p"), ("p.calibre2", ""), ("a:hover", ""), ("*", ""), ("*[lang]", ""), (".a.b", ""), ("#X ", "ID:x")]),
]


@pytest.mark.parametrize("f, cases", CASES)
def test_cases(spark, f, cases):
    assert values(spark, [c[0] for c in cases], f) == [c[1] for c in cases]


def test_declarations(spark):
    rows = [("font-weight", "700"), ("font-weight", "BOLD !important"), ("font-weight", "normal"), ("text-align", "centre"), ("break-before", "recto"), ("font-size", "2em"), ("font-size", "0"), ("text-decoration", "underline dotted"), ("color", "red"), ("font-style", "oblique")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, v string")
    got = [r.d for r in df.select("i", X.css_declaration(X.css_property(F.col("p")), X.css_value(F.col("v"))).alias("d")).orderBy("i").collect()]
    flags = [None if d is None else sorted(k for k in ("bold", "italic", "underline", "center", "page_break_before") if d[k]) + ([d.font_ratio] if d.font_ratio else []) for d in got]
    assert flags == [["bold"], ["bold"], None, ["center"], ["page_break_before"], [2.0], None, ["underline"], None, ["italic"]]


@given(st.lists(st.sampled_from(["a", "b", "..", ".", ""]), max_size=8), st.booleans())
def test_paths_are_stable(parts, rooted):
    once = paths.normalize("/" * rooted + "/".join(parts))
    assert paths.normalize(once) == once and ".." not in once.split("/")


def test_paths_agree(spark):
    inputs = ["a/b", "/x/../y", "./..//z", "a/../../b/./c/", "/", "q"]
    assert values(spark, inputs, X.path_normalize) == [paths.normalize(i) for i in inputs]
    assert values(spark, inputs, lambda x: X.path_join(F.lit("OEBPS"), x)) == [paths.join("OEBPS", i) for i in inputs]


def test_widths(spark):
    texts = ["abc", "日本", "é", "", "a\tb", "…", None]
    assert values(spark, texts, width.width) == [3, 4, 1, 0, 2, 1, None]
    assert values(spark, ["abcdef", "日本語", "ab"], lambda x: width.truncate(x, F.lit(4))) == ["abc…", "日…", "ab"]
    assert values(spark, ["ab", "日本語"], lambda x: width.pad(x, F.lit(5), 1)) == [" ab  ", "日本語"]


@settings(suppress_health_check=[HealthCheck.too_slow])
@given(st.text(max_size=30), st.integers(0, 12))
def test_truncated_fits(text, cells):
    assert width.text_width(width.truncate_text(text, cells)) <= cells
