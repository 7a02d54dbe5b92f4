"""Every query of the library against its SQL, or for what SQL can't express, that it gives rows."""

import re

import pytest
from conftest import SF

import __spark_entry__ as entry
from quire import config, queries
from quire.config import Options
from quire.functions.width import text_width


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, same_as_sql, name):
    df = entry.queries()[name](spark, SF)
    if name in queries.SQL:
        same_as_sql(df, queries.SQL[name])
    else:
        assert df.count() > 0


def test_h1_title_of_cut_references(spark, tmp_path):
    """References that a cut title leaves without a semicolon or that its SQL doesn't know, and a heading of level 2 before the first."""
    import duckdb

    bodies = ["<h1>a&amp;&amp;&amp b</h1>", "<h1>a&amp</h1>", "<h1>x = &quot;y&quot; &#39; &lt &copy z</h1>", "<h1>&amp;lt; &lt;b&gt; &amp;amp; & &&</h1>", "<h2>second</h2><h1 class=a>first <b>one</b></h1><h1>other</h1>", "<p>none &amp</p>"]
    rows = [(i, f"/{i}", f"<html><body>{b}<p>text</p></body></html>") for i, b in enumerate(bodies)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = [(r.page_id, r.title) for r in entry.queries()["html_h1_title"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.sql(queries.SQL["html_h1_title"]).fetchall()) and len(got) == 5


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain_pages(doc_id, text):
    """(start, count, is_title_page) of each page of a document set as a chapter of plain paragraphs: words laid down one by one, pages filled line by line."""
    options, title, count = Options(), f"document {doc_id}", 0
    for paragraph in text.split("\n"):
        words = [w for w in re.split("[ \t\r\xa0]+", paragraph) if w]
        joined = " ".join(words)
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), joined.replace("...", "…"))
        if not words or (not count and len(words) <= config.TITLE_REPEAT_MAX_WORDS and len(joined.encode()) >= 2 and (title in folded or folded in title)):
            continue
        count, room = count + 1, options.column_width - 4
        for i, w in enumerate(words):
            width = text_width(w)
            if i and room < width + 1:
                count, room = count + 1, options.column_width - width
            else:
                room -= width + (i > 0)
    return [(0, 0, True)] + [(s, min(options.page_height, count - s), False) for s in range(0, count, options.page_height)]


def test_paginate_as_plainly(spark):
    """Pages of every document, numbered over its source, against a plain version."""
    docs = sorted((r.source, r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect())
    want, number = [], {}
    for source, doc_id, text in docs:
        for k, page in enumerate(plain_pages(doc_id, text or ""), 1):
            number[source] = number.get(source, 0) + 1
            want.append((source, doc_id, k, *page, f"Document {doc_id}", number[source]))
    got = [(r.book_id, r.spine_index, r.page_in_chapter, r.start_line, r.line_count, r.is_title_page, r.section_title, r.global_page) for r in entry.queries()["paginate"](spark, SF).collect()]
    assert sorted(got) == sorted(want)
