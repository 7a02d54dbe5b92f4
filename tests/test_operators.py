import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire import queries as Q
from quire.config import Options
from quire.operators import clean, layout, navigate

BLOCKS = "book_id string, spine_index int, block_index int, anchor_id string, line string"


def pruned(spark, lines, **options):
    rows = [("b", 0, i, x[1] if isinstance(x, tuple) else None, x[0] if isinstance(x, tuple) else x) for i, x in enumerate(lines)]
    from quire.functions import text as X

    df = Q._typed(spark.createDataFrame(rows, BLOCKS).select("book_id", "spine_index", "block_index", F.col("anchor_id").alias("_a"), X.words("line").alias("words"))).withColumn("anchor_id", F.col("_a")).drop("_a")
    return [" ".join(w.text for w in r.words) for r in clean.prune(df, Options(**options)).orderBy("block_index").collect()]


@pytest.mark.parametrize(
    "lines, left",
    [
        (["The Great Iliad"] * 3, 3),
        (["The Great Iliad"] * 4, 0),
        ([("The Great Iliad", "x")] * 4, 4),
        (["1", "2", "3"], 3),
        (["1", "2", "3", "4"], 0),
        (["1", "2", "2", "3"], 4),
        (["Глава первая длинная"] * 10, 10),
        (["Short"] * 9, 9),
    ],
)
def test_pruning(spark, lines, left):
    assert len(pruned(spark, lines)) == left


def test_folios_are_trimmed(spark):
    folios = ["1", "2", "3", "4"]
    assert pruned(spark, [*folios, "one two three four five six seven 57"]) == ["one two three four five six seven"]
    assert pruned(spark, [*folios, "one two three four five six 57"]) == ["one two three four five six 57"]
    assert pruned(spark, [*folios, "it all began in the long year 1984."]) == ["it all began in the long year"]
    assert pruned(spark, ["Глава первая длинная"] * 4, unicode_norm=True) == []


@given(st.lists(st.integers(0, 30), max_size=40), st.integers(1, 40), st.integers(0, 4), st.integers(0, 4))
def test_wrapping(widths, column, first, rest):
    lines = layout.wrap(widths, column, first, rest)
    assert [w for s, e, _ in lines for w in widths[s:e]] == widths
    for s, e, indent in lines:
        assert e - s == 1 or indent + sum(widths[s:e]) + e - s - 1 <= column
    assert len(layout.wrap(widths, 2 * column, first, rest)) <= len(lines)


def test_native_fold_wraps_alike(spark):
    rows = [([3, 70, 2],), ([],), ([10] * 30,), ([66],), ([62, 1],)]
    df = spark.createDataFrame(rows, "w array<int>")
    assert [r.n for r in df.select(layout.word_lines(F.col("w"), 66, 4, 0).alias("n")).collect()] == [len(layout.wrap(w, 66, 4, 0)) for (w,) in rows]


def test_justified_lines_fill_the_column(spark):
    rows = [([5, 5, 5], 0, True), ([5, 5, 5], 0, False), ([1, 1], 0, True), ([9] * 5, 4, True), ([7], 0, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, w array<int>, i int, s boolean")
    got = [r.x for r in df.select("n", layout.justify_spaces(F.col("w"), F.col("i"), F.lit(20), F.col("n") + 1, F.col("s")).alias("x")).orderBy("n").collect()]
    assert got == [[2, 3, 0], [1, 1, 0], [1, 0], [1, 1, 1, 1, 0], [0]]


block = st.fixed_dictionaries({"type": st.sampled_from(["PARAGRAPH", "HEADING", "BLOCKQUOTE", "LIST_ITEM", "HR"]), "heading_level": st.integers(1, 3), "anchor_id": st.none() | st.just("a"), "section_title": st.none() | st.just("Part"), "toc_title": st.none() | st.sampled_from(["Part", "index"]), "texts": st.lists(st.sampled_from(["ab", "cdefg", "h"]), max_size=30)})


@given(st.lists(block, max_size=12), st.integers(4, 10), st.integers(0, 1))
def test_pages_part_the_lines(blocks, height, style):
    for i, b in enumerate(blocks):
        b["block_index"], b["widths"] = i, [len(t) for t in b["texts"]]
        if b["type"] == "HR":
            b["texts"], b["widths"] = [], []
    lines = layout.chapter_lines(blocks, "Title", 20, style)
    pages = layout.chapter_pages(lines, "Title", None, height)
    shown = [i for p in pages for i in range(p["start_line"], p["start_line"] + p["line_count"])]
    assert shown == sorted(set(shown)) and {i for i, x in enumerate(lines) if x.kind != "blank"} <= set(shown)
    assert all(p["line_count"] <= height for p in pages) and [p["page_in_chapter"] for p in pages] == list(range(1, len(pages) + 1))
    assert all(lines[p["start_line"]].kind != "blank" for p in pages if p["line_count"])


def test_geometry():
    assert [layout.column_width(t) for t in (20, 36, 80, 200)] == [18, 30, 66, 66] and layout.column_width(80, 86) == 78
    assert layout.page_height(5) == 4 and layout.page_height(40) == 36
    assert layout.kept_position(5, 10, 8) == 5 and layout.kept_position(9, 10, 5) == 5 and layout.kept_position(10, 10, 3) == 3


def test_toggle(spark):
    df = spark.createDataFrame([([1, 2], 2), ([1], 3), (list(range(256)), 999)], "b array<int>, p int")
    got = [r.t for r in df.select(navigate.toggle(F.col("b"), F.col("p")).alias("t")).collect()]
    assert [(g.bookmarks if len(g.bookmarks) < 9 else None, g.status) for g in got] == [([1], "removed"), ([1, 3], "added"), (None, "full")]


def test_bookmark_titles(spark):
    pages = spark.createDataFrame([("b", 1, "One"), ("b", 2, None)], "book_id string, global_page int, section_title string")
    state = spark.createDataFrame([("b", [2, 1, 9])], "book_id string, bookmarks array<int>")
    assert [r.section_title for r in navigate.bookmark_titles(state, pages).orderBy("place").collect()] == ["Chapter", "One", "Chapter"]


def test_streams(spark, tmp_path):
    from pyspark.sql import Row

    from quire.streaming import reading
    from test_sources import sample

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.epub").write_bytes(sample())
    reading.ingest(spark, str(tmp_path / "in"), str(tmp_path / "lib"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "lib/parsed")).first().title == "Il danno"

    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    events = [Row(book_id=1, page=5, action="move", ts=at(2), event_id=1), Row(book_id=1, page=3, action="move", ts=at(1), event_id=0), Row(book_id=1, page=7, action="toggle", ts=at(3), event_id=2), Row(book_id=1, page=8, action="toggle", ts=at(4), event_id=3), Row(book_id=1, page=7, action="toggle", ts=at(5), event_id=4)]
    frame = spark.createDataFrame(events)
    frame.write.parquet(str(tmp_path / "events"))
    stream = reading.replay(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "events")))
    q = stream.writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    row = spark.sql("SELECT * FROM states").first()
    assert (row.book_id, row.last_page, row.bookmarks) == (1, 5, [8])
