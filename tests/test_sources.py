import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire import config as C
from quire.config import Options
from quire.operators import cascade, toc
from quire.plans.library import Library
from quire.sources import css, html, state
from quire.sources.epub import parse_book

SHEET = """
/* made by a converter */
.calibre2 { font-size: 1.25em } p .bold, i.x {font-weight:700; /* no */ font-style: italic}
@font-face { font-family: "a;b{c" } @media print { .t { font-weight: bold } }
#main p { text-align: center } .pb { page-break-before: always; color: url(data:a;b) } a:hover { font-weight: bold }
"""


def test_sheet_rows():
    rows = list(css.rows(SHEET))
    assert rows[0] == ([".calibre2"], "font-size", "1.25em")
    assert rows[1][0] == ["p .bold", "i.x"] and rows[2][1:] == ("font-style", "italic")
    assert ([".t"], "font-weight", "bold") in rows and not any("family" in r[1] for r in rows)
    assert rows[-2] == ([".pb"], "color", "url(data:a;b)")


def test_rules(spark):
    decls = spark.createDataFrame([("b", i, s, p, v) for i, (s, p, v) in enumerate(css.rows(SHEET))], "book_id string, pos int, selectors array<string>, prop string, value string")
    got = {(r.kind, r.key): r for r in cascade.rules(decls).collect()}
    assert set(got) == {("CLASS", "calibre2"), ("CLASS", "bold"), ("CLASS", "t"), ("TAG", "p"), ("CLASS", "pb")}
    assert got["CLASS", "calibre2"].font_ratio == 1.25 and got["CLASS", "bold"].bold and got["CLASS", "bold"].italic and got["TAG", "p"].center


def test_resolve(spark):
    decls = spark.createDataFrame([("b", 0, ["p"], "font-size", "2em"), ("b", 1, ["#i"], "font-size", "3em"), ("b", 2, [".c"], "font-size", "1.5em"), ("b", 3, [".d"], "font-weight", "bold")], "book_id string, pos int, selectors array<string>, prop string, value string")
    elements = spark.createDataFrame([("b", 1, "P", "i", "c d", None), ("b", 2, "p", "i", None, None), ("b", 3, "p", None, "c", "font-size: 90%; text-align: center"), ("b", 4, "q", None, None, None)], "book_id string, element_id int, tag string, id string, class string, style string")
    got = {r.element_id: r for r in cascade.resolve(elements, cascade.rules(decls)).collect()}
    assert (got[1].font_ratio, got[1].bold) == (1.5, True) and got[2].font_ratio == 3.0
    assert round(got[3].font_ratio, 3) == 0.9 and got[3].center and got[4].font_ratio is None and not got[4].bold


def test_inherited_ratio(spark):
    row = spark.sql("SELECT array(float(3), float(4), float(0.1)) AS r").select(cascade.inherited_ratio(F.col("r")).alias("x")).first()
    assert round(row.x, 4) == 0.5  # 3, held to 5, then 0.5


def words(block):
    return [w[0] for w in block.words]


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<h1>A<br/>B</h1>", [("HEADING", ["A"]), ("PARAGRAPH", ["B"])]),
        ("<blockquote><p>x</p><p>y</p></blockquote>", [("BLOCKQUOTE", ["x"]), ("PARAGRAPH", ["y"])]),
        ("a<i>b</i>", [("PARAGRAPH", ["a", "b"])]),
        ("x&#160;y", [("PARAGRAPH", ["x", "y"])]),
        ("<script>if (a < b) {}</script><style>p</style><svg><text>n</text></svg>z", [("PARAGRAPH", ["z"])]),
        ("<p>one<p>two<hr>three", [("PARAGRAPH", ["one"]), ("PARAGRAPH", ["two"]), ("HR", []), ("PARAGRAPH", ["three"])]),
        ("<ul><li>a<li>b</ul>c", [("LIST_ITEM", ["a"]), ("LIST_ITEM", ["b", "c"])]),
        ("", []),
        ("<p> </p><p></p>", []),
    ],
)
def test_blocks(page, expected):
    assert [(b.type, words(b)) for b in html.parse(page)] == expected


def test_block_details():
    h1, p = html.parse("<h1 id=a>A <b>b</b></h1><div id='pb'></div><p><a name=m></a>x <em>y</em></p>")
    assert (h1.section_title, h1.anchor_id, h1.heading_level) == ("A b", "a", 1) and p.anchor_id == "m"
    assert [w[2] for w in p.words] == [0, C.ITALIC] and [w[3] for w in p.words] == [True, False]
    rules = {("CLASS", "c2"): (set(), 1.25), ("CLASS", "b"): ({"bold"}, None), ("CLASS", "c"): ({"center", "page_break_before"}, None)}
    (q,) = html.parse("<p class=c><span class=c2><span class='b'>7. Title</span></span></p>", rules)
    assert q.css_font_ratio == 1.25 and q.css_centered and q.css_page_break and all(w[2] == C.BOLD for w in q.words)


def test_nav_links():
    nav = "<nav epub:type='toc'><ol><li><a href='a.html'>One</a><ol><li><a href='a.html#x'>Two</a></li></ol></li><li><span>no</span></li></ol></nav><nav><ol><li><a href=z>z</a></ol></nav>"
    assert list(html.nav_links(nav)) == [("One", "a.html", 0), ("Two", "a.html#x", 1)]


CONTAINER = '<container xmlns="urn:x"><rootfiles><rootfile full-path="./a/../OEBPS/p.opf"/></rootfiles></container>'
OPF = """<package xmlns="u" xmlns:dc="d"><metadata><dc:title> Il danno </dc:title><dc:title>No</dc:title></metadata>
<spine toc="ncx"><itemref idref="c1"/><itemref idref="gone"/><itemref idref="c2" linear="no"/><itemref idref="c3"/><itemref idref="c4"/></spine>
<manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="s" href="s.css" media-type="text/css"/>
<item id="c1" href="c%201.xhtml" media-type="x"/><item id="c1" href="no.xhtml" media-type="x"/><item id="c2" href="c2.xhtml" media-type="x"/>
<item id="c3" href="c3.xhtml" media-type="x"/><item id="c4" href="c4.xhtml" media-type="x"/><item id="x"/></manifest></package>"""
NCX = """<ncx><navMap><navPoint playOrder="1"><navLabel><text>Start</text></navLabel><content src="c%201.xhtml#top"/>
<navPoint><navLabel><text>Inner</text></navLabel><content src="c%201.xhtml#in"/></navPoint><navPoint><navLabel><text>Last</text></navLabel><content src="c%201.xhtml#z"/></navPoint></navPoint></navMap></ncx>"""


def book(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def sample(chapters=4, ncx=NCX):
    page = lambda n: f"<html><body><p class='t'><span class='big'>Chapter {n} opens</span></p><p>The Great Iliad of Homer</p><p>{n}</p>" + "".join(f"<p>Word by word the text of chapter {n} goes on and on to part {k} until page {n}{k}</p>" for k in range(3)) + "</body></html>"
    pages = {f"OEBPS/{name}": page(i + 1) for i, name in enumerate(["c 1.xhtml", "c2.xhtml", "c3.xhtml", "c4.xhtml"][:chapters])}
    return book(**{"META-INF/container.xml": CONTAINER, "OEBPS/p.opf": OPF, "OEBPS/toc.ncx": ncx, "OEBPS/s.css": ".big { font-weight: bold; font-size: 1.3em } .t { page-break-before: always }"} | pages)


def test_parse_book():
    b = parse_book(sample())
    assert b["error"] is None and b["title"] == "Il danno" and b["opf_path"] == "OEBPS/p.opf" and b["opf_dir"] == "OEBPS"
    assert [k["title"] for k in b["links"]] == ["Start", "Inner", "Last"] and [k["level"] for k in b["links"]] == [0, 1, 1]
    assert b["manifest"][2]["full_path"] == "OEBPS/c 1.xhtml" and b["itemrefs"][2]["linear"] is False
    strict = parse_book(sample(), strict=True)
    assert strict["error"] == "empty spine"  # the spine stands before the manifest


@pytest.mark.parametrize("content, error", [(b"no", "not a ZIP archive"), (book(a="x"), "no META-INF/container.xml"), (book(**{"META-INF/container.xml": "<a/>"}), "no root file in the container"), (book(**{"META-INF/container.xml": CONTAINER}), "no package document OEBPS/p.opf")])
def test_errors(content, error):
    assert parse_book(content)["error"] == error


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    (folder / "one.epub").write_bytes(sample())
    (folder / "bad.epub").write_bytes(b"?")
    return Library.read(spark, str(folder), Options(column_width=40, page_height=6)).save(str(tmp_path_factory.mktemp("library")))


def test_library_tables(library):
    errors = {r.filepath.rpartition("/")[2]: r.error for r in library.books.collect()}
    assert errors == {"one.epub": None, "bad.epub": "not a ZIP archive"}
    assert [(r.spine_index, r.idref) for r in library.spine.orderBy("spine_index").collect()] == [(0, "c1"), (1, "c2"), (2, "c3"), (3, "c4")]
    blocks = library.blocks.orderBy("spine_index", "block_index").collect()
    text = [" ".join(w.text for w in b.words) for b in blocks]
    assert "The Great Iliad of Homer" not in text and "3" not in text  # a running head and folios
    assert not any(t.endswith(("10", "42")) for t in text)
    heads = [b for b in blocks if b.type == "HEADING"]
    assert [(h.section_title, h.heading_level, h.anchor_id) for h in heads] == [(f"Chapter {i + 1} opens", 1, f"quire-h-{i}-0") for i in range(4)]


def test_library_contents(library):
    toc = library.toc.orderBy("toc_index").collect()
    # one of four chapters is covered, so headings come first and what they don't repeat follows
    assert [t.title for t in toc] == [*(f"Chapter {i} opens" for i in range(1, 5)), "Start", "Inner", "Last"]
    assert [t.origin for t in toc][-1] == "ncx" and toc[4].anchor == "top"
    lines = [r.line for r in library.info().orderBy("line_no").collect()]
    assert lines[0] == "Title:     Il danno" and lines[3:7] == ["Chapters:  4 spine documents", "TOC Items: 7 entries", "", "Table of Contents:"] and "• Chapter 2 opens (Spine item 2)" in lines and "  • Inner (Spine item 1)" in lines


def test_library_pages(library):
    pages = library.pages.orderBy("global_page").collect()
    assert [p.global_page for p in pages] == list(range(1, len(pages) + 1))
    assert pages[0].is_title_page and pages[0].section_title == "Chapter 1 opens"
    lines = library.lines.collect()
    solid = {(r.spine_index, r.line_index) for r in lines if r.kind != "blank"}
    shown = [(p.spine_index, i) for p in pages for i in range(p.start_line, p.start_line + p.line_count)]
    assert len(shown) == len(set(shown)) and solid <= set(shown)
    assert all(r.total_width == 40 for r in lines if r.kind == "text" and not r.is_last)
    found = {t.title: t.page for t in library.toc_pages.collect()}
    first = {p.spine_index: p.global_page for p in reversed(pages)}
    assert all(found[f"Chapter {i + 1} opens"] == first[i] for i in range(4)) and found["Inner"] == 1
    hits = library.search("GOES").orderBy("match").collect()
    assert len(hits) == 12 and hits[0].global_page == 2
    book_id = pages[0].book_id
    rows = {r.row: r.text for r in library.page(book_id, 2, {"bookmarks": [2]}).collect()}
    assert rows[9].startswith(f"  ★ ← Pag. 2/{len(pages)} →") and rows[2].startswith("      Word by word") and rows[0].startswith("  Il danno")
    rows = {r.row: r.text for r in library.page(book_id, 2, query="goes", clock="2:34am", terminal=(80, 24)).collect()}
    assert rows[23].startswith(" " * 20 + "← Pag. 2/") and "[Match 1 of 12]" in rows[23] and rows[23].endswith("2:34am") and len(rows[23]) == 60
    title = {r.row: r.text for r in library.page(book_id, 1, terminal=(60, 24)).collect()}
    assert [t.strip() for t in title.values()] == ["Il danno", "Chapter 1 opens", "─── ✦ ───", title[23].strip()] and title[23].strip().startswith(f"Pag. 1/{len(pages)} →")
    assert library.page(book_id, len(pages) + 1).count() == 0
    listed = library.contents(book_id, 3).collect()
    assert [r.title for r in listed if r.selected] == ["Chapter 1 opens"] or sum(r.selected for r in listed) == 1
    assert library.chapter_page(book_id, 2) == first[1] and library.entries.count() == 4


def test_command(spark, tmp_path, capsys):
    from quire.__main__ import main

    (tmp_path / "b.epub").write_bytes(sample())
    (tmp_path / "bad.epub").write_bytes(b"?")
    assert main([str(tmp_path / "b.epub"), "-c", "2"]) == 0 and "Chapter 2 opens" in capsys.readouterr().out
    assert main([str(tmp_path / "bad.epub")]) == 1 and main([]) == 1 and "ERROR" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        main(["--version"])


def test_render():
    from datetime import datetime

    from quire.operators import navigate, render

    assert render.header("A" * 40, "Section", 40, 2) == "  " + "A" * 17 + "…" + " " * 15 + "Section"
    assert render.header("Book", "", 40, 0) == "Book" and render.header("Book", "Section", 40, 0, True) == "Book"
    assert render.footer(1, 3, False, None, "", 40, 0, 40) == "  Pag. 1/3 →    [ 33% ]"
    assert render.footer(3, 3, True, (1, 2), "1:05pm", 60, 0, 60).startswith("★ ← Pag. 3/3  ") and render.footer(3, 3, True, (1, 2), "1:05pm", 60, 0, 60).endswith("1:05pm")
    assert [render.clock_text(datetime(2024, 1, 1, h, 5)) for h in (0, 2, 12, 23)] == ["12:05am", "2:05am", "12:05pm", "11:05pm"]
    assert render.title_page("One Two", 20, 1, 5) == [] or render.title_page("One Two", 20, 1, 24)[0] == (7, " " * 7 + "One Two")
    assert len(render.title_rows(" ".join(["word"] * 900), 4)) == 4
    assert [navigate.scroll_offset(s, 5, o) for s, o in ((0, 0), (4, 0), (5, 0), (2, 4), (9, 7))] == [0, 0, 1, 2, 7]


def test_fallback_and_synthesis(spark, tmp_path):
    (tmp_path / "b.epub").write_bytes(sample(ncx="<ncx/>"))
    saved = Library.read(spark, str(tmp_path)).save(str(tmp_path / "saved"))
    assert [t.title for t in saved.toc.orderBy("toc_index").collect()] == [f"Chapter {i} opens" for i in range(1, 5)]
    kept = toc.synthesize(saved.first_toc, saved.spine, saved.blocks, Options(synthesize_over_fallback=False))
    assert [t.title for t in kept.orderBy("toc_index").collect()] == [f"Chapter {i}" for i in range(1, 5)]


STATE = """[BOOK:a:1:2]
last_page=42
theme=1
column_width=66
full_justify=0
bookmarks=12,0,42,x,108

[BOOK:b]
last_page=0
bookmarks=
[BOOK:a:1:2]
last_page=7
"""


def test_states(spark, tmp_path):
    (tmp_path / "state").write_text(STATE)
    got = {r.book_id: r for r in state.load_states(spark, str(tmp_path / "state")).collect()}
    a, b = got["a:1:2"], got["b"]
    assert (a.last_page, a.theme, a.column_width, a.full_justify, a.bookmarks) == (42, 1, 66, False, [12, 42, 108])
    assert (b.last_page, b.theme, b.full_justify, b.paragraph_style, b.bookmarks) == (1, 0, True, 0, [])
    old = state.load_states(spark, str(tmp_path / "state"))
    new = old.where("book_id = 'b'").withColumn("last_page", F.lit(9).cast("bigint"))
    state.save_states(state.upsert(old, new), str(tmp_path / "out"))
    again = {r.book_id: r for r in state.load_states(spark, str(tmp_path / "out")).collect()}
    assert again["b"].last_page == 9 and again["a:1:2"] == a
    odd = """  [BOOK:o]  \nlast_page = 99999999999999999999\n[not a header\ntheme=2 or so\nfull_justify=no\nbookmarks=5\nbookmarks=6,-7\n[OTHER]\ntheme=9\n"""
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "1").write_text(odd)
    (tmp_path / "odd" / "2").write_text("[BOOK:o]\ntheme=7\n")
    (o,) = state.load_states(spark, str(tmp_path / "odd")).collect()
    assert (o.last_page, o.theme, o.full_justify, o.bookmarks) == ((1 << 63) - 1, 2, False, [5, 6])
    (tmp_path / "many").write_text("[BOOK:m]\nbookmarks=" + ",".join(map(str, range(1, 400))))
    assert len(state.load_states(spark, str(tmp_path / "many")).first().bookmarks) == 256
