"""Typesetting: blocks to lines, lines to pages. The two folds are plain functions, run for each chapter; what follows from lines is native."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import config as C
from quire.config import Options

INDENTS = {"PARAGRAPH": (4, 0), "BLOCKQUOTE": (4, 4), "LIST_ITEM": (2, 4)}
#: Title comparison folds A-Z alone.
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_junk(title: str | None) -> bool:
    return not title or title.translate(FOLD) in C.JUNK_TITLES


def plain_title(title: str) -> str:
    spaced = " ".join(p for p in title.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if p)
    return spaced.replace("...", "…").encode()[: C.TITLE_MAX_BYTES].decode("utf-8", "ignore")


def same_title(a: str | None, b: str | None) -> bool:
    return bool(a and b) and plain_title(a) == plain_title(b) != ""


def repeats_title(kind: str, words: list[str], title: str | None) -> bool:
    if not title or kind not in ("HEADING", "PARAGRAPH"):
        return False
    if kind == "HEADING":
        return True
    text = " ".join(words)
    if not 1 <= len(words) <= C.TITLE_REPEAT_MAX_WORDS or len(text.encode()) < 2:
        return False
    a, b = plain_title(title).translate(FOLD), plain_title(text).translate(FOLD)
    return bool(a and b) and (a in b or b in a)


def wrap(widths: list[int], column: int, first: int, rest: int) -> list[tuple[int, int, int]]:
    """(start, end, indent) of each line: a word goes on the next line if it doesn't fit and isn't the first; none is split."""
    out, start, used = [], 0, first
    for i, w in enumerate(widths):
        space = i > start
        if space and used + 1 + w > column:
            out.append((start, i, rest if start else first))
            start, used = i, rest + w
        else:
            used += space + w
    if start < len(widths):
        out.append((start, len(widths), rest if start else first))
    return out


@dataclass
class Line:
    block_index: int
    section_title: str | None
    kind: str = "text"  # text, heading, hr, blank
    start: int = 0
    end: int = 0
    indent: int = 0
    heading_level: int = 0
    last: bool = False
    centered: bool = False
    section_start: bool = False
    anchor_id: str | None = None


def chapter_lines(blocks: list[dict], chapter_title: str | None, column: int, style: int) -> list[Line]:
    """blocks: dicts of block_index, type, heading_level, anchor_id, section_title, toc_title, texts, widths."""
    lines: list[Line] = []
    section, flagged, kept_anchor = chapter_title, False, None

    def blank() -> None:
        lines.append(Line(block["block_index"], section, "blank"))

    def gap() -> bool:
        """A blank line, unless at the top or after one."""
        if lines and lines[-1].kind != "blank":
            blank()
            return True
        return False

    for block in blocks:
        kind, toc_title = block["type"], block["toc_title"]
        opens = toc_title is not None and not is_junk(toc_title)
        section = toc_title if opens else block["section_title"] or section
        begin = None
        if kind == "HR":
            gap()
            begin = len(lines)
            lines.append(Line(block["block_index"], section, "hr", centered=True))
        elif not block["texts"]:
            continue
        else:
            flagged = flagged or opens or (kind == "HEADING" and bool(block["section_title"]))
            if (opens or toc_title is not None or not lines) and repeats_title(kind, block["texts"], section):
                kept_anchor = block["anchor_id"]
                continue
            anchor, kept_anchor = kept_anchor or block["anchor_id"], None
            heading = kind == "HEADING"
            first, rest = INDENTS.get(kind, (0, 0))
            if kind == "PARAGRAPH" and style:
                first = 0
            if heading:
                if gap() and block["heading_level"] <= 2:
                    blank()
            elif kind == "BLOCKQUOTE" or (kind == "PARAGRAPH" and style):
                gap()
            begin = len(lines)
            parts = wrap(block["widths"], column, first, rest)
            for k, (start, end, indent) in enumerate(parts):
                lines.append(Line(block["block_index"], section, "heading" if heading else "text", start, end, indent, block["heading_level"] if heading else 0, heading or k == len(parts) - 1, heading and block["heading_level"] <= 2, False, anchor if k == 0 else None))
        if flagged and begin is not None:
            lines[begin].section_start, flagged = True, False
        if kind in ("HR", "HEADING"):
            blank()
    return lines


def chapter_pages(lines: list[Line], chapter_title: str | None, doc_title: str | None, height: int) -> list[dict]:
    """Pages of a chapter: dicts of page_in_chapter, start_line, line_count, section_title, is_title_page, anchor_id."""
    height = height if height > 0 else 20
    pages: list[dict] = []
    last_solid = max((i for i, x in enumerate(lines) if x.kind != "blank"), default=-1)

    def page(**more) -> None:
        pages.append({"page_in_chapter": len(pages) + 1, "start_line": 0, "line_count": 0, "section_title": None, "is_title_page": False, "anchor_id": None} | more)

    def title_page(title: str | None, anchor: str | None) -> None:
        if is_junk(title):
            return
        if pages and pages[-1]["is_title_page"] and same_title(pages[-1]["section_title"], title):
            pages[-1]["anchor_id"] = pages[-1]["anchor_id"] or anchor
        else:
            page(section_title=title, is_title_page=True, anchor_id=anchor)

    title_page(chapter_title, None)
    at = 0
    while True:
        while at < len(lines) and lines[at].kind == "blank":
            at += 1
        if at == len(lines):
            break
        head, start = lines[at], at
        if head.section_start and last_solid > at:
            if same_title(head.section_title, chapter_title) and pages and pages[0]["is_title_page"]:
                pages[0]["anchor_id"] = pages[0]["anchor_id"] or head.anchor_id
            else:
                title_page(head.section_title, head.anchor_id)
        at += 1
        while at < len(lines) and at - start < height and not lines[at].section_start:
            at += 1
        if at < len(lines) and at - start > 1 and lines[at - 1].kind == "heading":
            at -= 1
        end = at
        while end > start and lines[end - 1].kind == "blank":
            end -= 1
        page(start_line=start, line_count=end - start, section_title=head.section_title or doc_title)
    if not pages:
        page(section_title=doc_title or "Chapter")
    return pages


LINE = pa.struct([("line_index", pa.int32()), ("block_index", pa.int32()), ("section_title", pa.string()), ("kind", pa.string()), ("texts", pa.list_(pa.string())), ("widths", pa.list_(pa.int32())), ("indent_spaces", pa.int32()), ("heading_level", pa.int32()), ("is_last", pa.bool_()), ("is_centered", pa.bool_()), ("is_section_start", pa.bool_()), ("anchor_id", pa.string())])
PAGE = pa.struct([("page_in_chapter", pa.int32()), ("start_line", pa.int32()), ("line_count", pa.int32()), ("section_title", pa.string()), ("is_title_page", pa.bool_()), ("anchor_id", pa.string())])
LAYOUT = (
    "book_id string, spine_index int, chapter_title string, "
    "lines array<struct<line_index:int,block_index:int,section_title:string,kind:string,texts:array<string>,widths:array<int>,indent_spaces:int,heading_level:int,is_last:boolean,is_centered:boolean,is_section_start:boolean,anchor_id:string>>, "
    "pages array<struct<page_in_chapter:int,start_line:int,line_count:int,section_title:string,is_title_page:boolean,anchor_id:string>>"
)


def typeset(chapters: DataFrame, blocks: DataFrame, options: Options = Options()) -> DataFrame:
    """A row for each of chapters(book_id, spine_index, title, chapter_title) with its lines and pages.

    blocks has toc_title beside the block columns. A chapter's blocks are gathered by an aggregate, so what a task holds is one chapter.
    """
    column, height, style = options.column_width, options.page_height, options.paragraph_style
    fields = ["block_index", "type", "heading_level", "anchor_id", "section_title", "toc_title", F.transform("words", lambda w: w["text"]).alias("texts"), F.transform("words", lambda w: w["visual_width"]).alias("widths")]
    gathered = blocks.groupBy("book_id", "spine_index").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("blocks"))
    rows = chapters.select("book_id", F.col("spine_index").cast("int").alias("spine_index"), "title", "chapter_title").join(gathered, ["book_id", "spine_index"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                parts = {b["block_index"]: b for b in row["blocks"] or ()}
                lines = chapter_lines(row["blocks"] or [], row["chapter_title"], column, style)
                out = []
                for i, x in enumerate(lines):
                    b = parts[x.block_index]
                    out.append({"line_index": i, "block_index": x.block_index, "section_title": x.section_title, "kind": x.kind, "texts": b["texts"][x.start : x.end], "widths": b["widths"][x.start : x.end], "indent_spaces": x.indent, "heading_level": x.heading_level, "is_last": x.last, "is_centered": x.centered, "is_section_start": x.section_start, "anchor_id": x.anchor_id})
                pages = chapter_pages(lines, row["chapter_title"], row["title"], height)
                yield pa.RecordBatch.from_arrays([pa.array([row["book_id"]], pa.string()), pa.array([row["spine_index"]], pa.int32()), pa.array([row["chapter_title"]], pa.string()), pa.array([out], pa.list_(LINE)), pa.array([pages], pa.list_(PAGE))], ["book_id", "spine_index", "chapter_title", "lines", "pages"])

    return rows.mapInArrow(run, LAYOUT)


def lines_table(laid: DataFrame, options: Options = Options()) -> DataFrame:
    """(book_id, spine_index, line_index, ...) with spaces_after and total_width."""
    rows = laid.select("book_id", "spine_index", F.explode("lines").alias("x")).select("book_id", "spine_index", "x.*")
    column = F.lit(options.column_width)
    stretched = F.lit(options.full_justify) & (F.col("kind") == "text") & ~F.col("is_last") & ~F.col("is_centered")
    spaces = justify_spaces(F.col("widths"), F.col("indent_spaces"), column, F.col("line_index") + 1, stretched)
    rows = rows.withColumn("spaces_after", spaces)
    total = F.col("indent_spaces") + F.aggregate("widths", F.lit(0), lambda a, w: a + w) + F.aggregate("spaces_after", F.lit(0), lambda a, w: a + w)
    return rows.withColumn("total_width", F.when(F.col("kind") == "hr", column).otherwise(total))


def justify_spaces(widths: Column, indent: Column, column: Column, ordinal: Column, stretch: Column) -> Column:
    """Spaces after each word of a line. Stretched lines fill the column: what is left over goes from the left on even lines, from the right on odd ones.

    ordinal counts the chapter's lines from 1. Lines too sparse or too full to stretch have single spaces.
    """
    gaps = F.size(widths) - 1
    need = column - F.aggregate(widths, F.lit(0), lambda a, w: a + w) - indent
    fits = stretch & (gaps > 0) & (need >= gaps) & (need - gaps <= F.floor(column / 2))
    parts = F.greatest(gaps, F.lit(1))
    base, rest = F.floor(need / parts).cast("int"), need % parts

    def spaces(i: Column) -> Column:
        extra = F.when(ordinal % 2 == 0, i < rest).otherwise(i >= gaps - rest).cast("int")
        return F.when(i == gaps, 0).when(fits, base + extra).otherwise(1)

    return F.transform(widths, lambda w, i: spaces(i))


def pages_table(laid: DataFrame) -> DataFrame:
    from quire.operators.navigate import number_pages

    return number_pages(laid.select("book_id", "spine_index", F.explode("pages").alias("x")).select("book_id", "spine_index", "x.*"))


def line_text(texts: Column, spaces_after: Column, indent: Column) -> Column:
    words = F.transform(texts, lambda t, i: F.concat(t, F.repeat(F.lit(" "), F.get(spaces_after, i))))
    return F.concat(F.repeat(F.lit(" "), indent), F.array_join(words, ""))


def wrapped(rows: DataFrame, column: int, first: int, rest: int, *keys: str) -> DataFrame:
    """(keys, line, widths, indent, is_last): the lines, from 0, that each of rows(keys, widths) is wrapped to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                widths = batch.column("widths")[i].as_py()
                lines = wrap(widths, column, first, rest)
                n = len(lines)
                of = [pa.array([batch.column(k)[i].as_py()] * n, batch.column(k).type) for k in keys]
                yield pa.RecordBatch.from_arrays([*of, pa.array(range(n), pa.int32()), pa.array([widths[s:e] for s, e, _ in lines], pa.list_(pa.int32())), pa.array([x for *_, x in lines], pa.int32()), pa.array([k == n - 1 for k in range(n)], pa.bool_())], [*keys, "line", "widths", "indent", "is_last"])

    kinds = dict(rows.dtypes)
    return rows.select(*keys, "widths").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", line int, widths array<int>, indent int, is_last boolean")


def word_lines(widths: Column, column: int, first: int, rest: int) -> Column:
    """How many lines wrap() gives, as a native fold."""
    start = F.struct(F.lit(0).alias("lines"), F.lit(first).alias("used"))

    def step(a: Column, w: Column) -> Column:
        new = (a["lines"] == 0) | (a["used"] + 1 + w > column)
        used = F.when(a["lines"] == 0, first + w).when(new, rest + w).otherwise(a["used"] + 1 + w)
        return F.struct(F.when(new, a["lines"] + 1).otherwise(a["lines"]).cast("int").alias("lines"), used.cast("int").alias("used"))

    return F.aggregate(widths, start, step, lambda a: a["lines"])


def column_width(terminal_width: int, wanted: int = 0) -> int:
    """The text column on a terminal; 0 wants the automatic one."""
    most = terminal_width - 2
    column = wanted or min(terminal_width - 6, C.AUTO_COLUMN)
    return min(column if column >= 30 else most, most)


def page_height(terminal_height: int) -> int:
    return max(terminal_height - 4, C.MIN_PAGE_HEIGHT)


def kept_position(page: int, old_total: int, new_total: int) -> int:
    """The page to show after a new layout: the same number if there still is one, else in proportion."""
    if page <= new_total:
        return max(1, page)
    return min(new_total, max(1, int(page / max(1, old_total) * new_total + 0.5)))
