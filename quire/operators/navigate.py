"""Finding one's way: page numbers, searches, contents, bookmarks and reading states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire import config as C
from quire.functions import text as X


def numbered(rows: DataFrame, name: str, part: str, *order: str) -> DataFrame:
    """rows(book_id, part, ...) with column `name`: their number from 1 over the book, in the order of part and then of order.

    Rows are numbered within each part, and only the parts' counts are added up over a book, so a long book isn't one task.
    """
    counts = rows.groupBy("book_id", part).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy("book_id").orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("book_id", part).orderBy(*order))
    return rows.join(counts.withColumn("_before", before).drop("_rows"), ["book_id", part]).withColumn(name, (within + F.col("_before")).cast("int")).drop("_before")


def number_pages(pages: DataFrame) -> DataFrame:
    """pages(book_id, spine_index, page_in_chapter, ...) with global_page from 1 over the book."""
    return numbered(pages, "global_page", "spine_index", "page_in_chapter")


def chapter_first_pages(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book_id", "spine_index").agg(F.min("global_page").alias("first_page"), F.count(F.lit(1)).alias("pages"))


def search(words: DataFrame, query: str) -> DataFrame:
    """Rows of words(book_id, global_page, line_index, word_index, word) that hold the query, ASCII case ignored; match counts from 0 within the book."""
    query = query.strip(" \t\n\r\x0b\f").encode()[:127].decode("utf-8", "ignore")
    found = words.where(X.contains_ignoring_case("word", F.lit(query)) & F.lit(query != ""))
    return numbered(found, "match", "global_page", "line_index", "word_index").withColumn("match", F.col("match") - 1)


def first_match(matches: DataFrame, current_page: Column) -> DataFrame:
    """(book_id, match): the first at or after a page, else the first of all."""
    return matches.groupBy("book_id").agg(F.coalesce(F.min(F.when(F.col("global_page") >= current_page, F.col("match"))), F.min("match")).alias("match"))


def next_previous(matches: DataFrame) -> DataFrame:
    """matches with the next and previous match, around the ends."""
    n = matches.groupBy("book_id").agg(F.count(F.lit(1)).alias("_n"))
    return matches.join(n, "book_id").withColumns({"next_match": ((F.col("match") + 1) % F.col("_n")).cast("int"), "previous_match": ((F.col("match") - 1 + F.col("_n")) % F.col("_n")).cast("int")}).drop("_n")


def toc_pages(toc: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """toc with page: that of its anchor; else that whose lines hold the anchor; else its chapter's first; else 1."""
    by_anchor = pages.where("anchor_id IS NOT NULL").groupBy("book_id", "spine_index", F.col("anchor_id").alias("anchor")).agg(F.min("global_page").alias("_p"))
    line = lines.where("anchor_id IS NOT NULL").groupBy("book_id", "spine_index", F.col("anchor_id").alias("anchor")).agg(F.min("line_index").alias("_line"))
    spans = pages.where("line_count > 0").select("book_id", "spine_index", "start_line", "line_count", "global_page")
    in_lines = line.join(spans, ["book_id", "spine_index"]).where((F.col("_line") >= F.col("start_line")) & (F.col("_line") < F.col("start_line") + F.col("line_count"))).groupBy("book_id", "spine_index", "anchor").agg(F.min("global_page").alias("_q"))
    firsts = chapter_first_pages(pages).select("book_id", "spine_index", F.col("first_page").alias("_r"))
    key = ["book_id", "spine_index", "anchor"]
    return toc.join(by_anchor, key, "left").join(in_lines, key, "left").join(firsts, ["book_id", "spine_index"], "left").withColumn("page", F.coalesce("_p", "_q", "_r", F.lit(1))).drop("_p", "_q", "_r")


def current_entry(toc_paged: DataFrame, current: DataFrame) -> DataFrame:
    """(book_id, toc_index): the last entry of the leading run whose pages are at or before current(book_id, current_page); 0 if none."""
    rows = toc_paged.join(current, "book_id")
    passed = F.min((F.col("page") <= F.col("current_page")).cast("int")).over(W.partitionBy("book_id").orderBy("toc_index"))
    return rows.withColumn("_in", passed).groupBy("book_id").agg(F.coalesce(F.max(F.when(F.col("_in") == 1, F.col("toc_index"))), F.lit(0)).alias("toc_index"))


def contents_list(toc_paged: DataFrame, current: DataFrame) -> DataFrame:
    """(book_id, toc_index, level, title, page, selected) for the books of current(book_id, current_page): selected is the entry to begin at."""
    rows = toc_paged.select("book_id", "toc_index", "level", "title", "page")
    chosen = current_entry(toc_paged, current).select("book_id", F.col("toc_index").alias("_at"))
    return rows.join(chosen, "book_id").withColumn("selected", F.col("toc_index") == F.col("_at")).drop("_at")


def scroll_offset(selected: int, visible: int, offset: int = 0) -> int:
    """The first entry to show of a list, so that the selected one is among the visible ones and the list moves no more than it must."""
    return min(selected, max(offset, selected - max(1, visible) + 1))


def goto_page(wanted: Column, total: Column) -> Column:
    return F.least(F.greatest(wanted, F.lit(1)), total)


def next_chapter_page(pages: DataFrame, current_page: int) -> DataFrame:
    """(book_id, next_page, previous_page): the next chapter's first page, and this one's, or the one before's if there already; null at the ends."""
    firsts = chapter_first_pages(pages)
    order = W.partitionBy("book_id").orderBy("spine_index")
    firsts = firsts.withColumns({"_next": F.lead("first_page").over(order), "_before": F.lag("first_page").over(order), "_last": F.col("first_page") + F.col("pages") - 1})
    here = firsts.where((F.col("first_page") <= current_page) & (F.col("_last") >= current_page))
    return here.select("book_id", F.col("_next").alias("next_page"), F.when(F.col("first_page") == current_page, F.col("_before")).otherwise(F.col("first_page")).alias("previous_page"))


def toggle(bookmarks: Column, page: Column) -> Column:
    """struct(bookmarks, status): page taken out if there ('removed'), else put last ('added') unless there are 256 ('full')."""
    there, full = F.array_contains(bookmarks, page), F.size(bookmarks) >= C.MAX_BOOKMARKS
    changed = F.when(there, F.array_remove(bookmarks, page)).when(full, bookmarks).otherwise(F.concat(bookmarks, F.array(page)))
    return F.struct(changed.alias("bookmarks"), F.when(there, "removed").when(full, "full").otherwise("added").alias("status"))


def bookmarked(toggles: DataFrame, *key: str) -> DataFrame:
    """Of toggles, the keys that were toggled an odd number of times."""
    return toggles.groupBy(*key).agg(F.count(F.lit(1)).alias("toggles")).where("toggles % 2 = 1")


def bookmark_titles(state: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, place, page, section_title) of state(book_id, bookmarks), in the order they were set."""
    marks = state.select("book_id", F.posexplode("bookmarks").alias("place", "page"))
    return marks.join(pages.select("book_id", F.col("global_page").alias("page"), "section_title"), ["book_id", "page"], "left").withColumn("section_title", F.coalesce("section_title", F.lit("Chapter")))


def last_positions(events: DataFrame, book: str, page: str, *order: str) -> DataFrame:
    """(book, page): each book's page in its last event."""
    return events.groupBy(book).agg(F.max_by(page, F.struct(*order)).alias(page))


def carry_titles(rows: DataFrame, title: Column, order: str, seed: Column, *key: str) -> DataFrame:
    """rows with section_title: the last title so far, at first the seed."""
    window = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("section_title", F.coalesce(F.last(title, ignorenulls=True).over(window), seed))


def first_bookmarks(pages: DataFrame, *order: str) -> DataFrame:
    """(book_id, bookmarks) of pages(book_id, page, ...): the first 256 in that order; no more than those are gathered."""
    place = F.row_number().over(W.partitionBy("book_id").orderBy(*order))
    first = pages.withColumn("place", place).where(F.col("place") <= C.MAX_BOOKMARKS)
    return first.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "page"))), lambda x: x["page"]).alias("bookmarks"))


def info_lines(books: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, line_no, line): a header of books(book_id, title, author, language, chapters), then the contents by level."""
    mapped = F.when(F.col("spine_index") >= 0, F.concat(F.lit(" (Spine item "), (F.col("spine_index") + 1).cast("string"), F.lit(")"))).otherwise("")
    contents = toc.select("book_id", (F.col("toc_index") + 7).alias("line_no"), F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("• "), "title", mapped).alias("line"))
    entries = toc.groupBy("book_id").agg(F.count(F.lit(1)).alias("_entries"))
    known = lambda label, c: F.concat(F.lit(label), F.coalesce(F.col(c), F.lit("Unknown")))
    number = lambda label, c, what: F.concat(F.lit(label), F.coalesce(F.col(c), F.lit(0)).cast("string"), F.lit(what))
    head = F.array(known("Title:     ", "title"), known("Author:    ", "author"), known("Language:  ", "language"), number("Chapters:  ", "chapters", " spine documents"), number("TOC Items: ", "_entries", " entries"), F.lit(""), F.lit("Table of Contents:"))
    return books.join(entries, "book_id", "left").select("book_id", F.posexplode(head).alias("line_no", "line")).unionByName(contents)
