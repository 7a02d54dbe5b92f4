"""Blocks: from plain text, pruned of running heads and folios, and headings recovered.

A table of blocks has book_id, spine_index, block_index, type, heading_level, anchor_id, section_title, css_heading,
css_page_break, css_centered, css_font_ratio and words (structs of text, visual_width, style, space_after).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire import config as C
from quire.config import Options
from quire.functions import text as X


def texts(words: Column | str = "words") -> Column:
    return F.transform(words, lambda w: w["text"])


def plain_text(words: Column | str = "words") -> Column:
    return F.array_join(texts(words), " ")


def lines_of(docs: DataFrame, book: str, chapter: str, text: str = "text") -> DataFrame:
    """(book_id, spine_index, block_index, words): each line with words in it is a paragraph."""
    rows = docs.select(F.col(book).cast("string").alias("book_id"), F.col(chapter).alias("spine_index"), F.posexplode(F.split(text, "\n")).alias("block_index", "line"))
    return rows.select("book_id", "spine_index", "block_index", X.words("line").alias("words")).where(F.size("words") > 0)


def drop_empty(blocks: DataFrame) -> DataFrame:
    """HR blocks and those with words, numbered anew from 0."""
    order = W.partitionBy("book_id", "spine_index").orderBy("block_index")
    return blocks.where((F.col("type") == "HR") | (F.size("words") > 0)).withColumn("block_index", F.row_number().over(order) - 1)


def eligible(words: Column, norm: Column) -> Column:
    """Whether a paragraph could be a running head."""
    return F.size(words).between(1, C.RUNNING_HEAD_MAX_WORDS) & ~X.is_page_number(words) & (F.octet_length(norm) >= C.RUNNING_HEAD_MIN_BYTES)


def judged(lines: DataFrame, unicode_norm: bool = False) -> DataFrame:
    """lines with norm and eligible."""
    norm = X.normalized_text(F.array_join("words", " "), unicode_norm)
    lines = lines.withColumn("norm", norm)
    return lines.withColumn("eligible", eligible(F.col("words"), F.col("norm")))


def counted(lines: DataFrame, unicode_norm: bool = False) -> DataFrame:
    """judged() lines with `repeats`: of running heads, the lines of the book that have the same norm; null for all others.

    The counts are aggregated before they are joined back, and only to lines that can be a running head, so neither a running head
    of a large book nor the many lines of one norm that can't be one meet in one task; heads are few, and are broadcast where Spark finds them small enough.
    """
    lines = judged(lines, unicode_norm)
    heads = lines.where("eligible").groupBy("book_id", "norm").agg(F.count(F.lit(1)).alias("repeats")).where(F.col("repeats") >= C.RUNNING_HEAD_MIN_REPEATS)
    return lines.where("eligible").join(heads, ["book_id", "norm"], "left").unionByName(lines.where(~F.col("eligible")).withColumn("repeats", F.lit(None).cast("bigint")))


def summary(lines: DataFrame, unicode_norm: bool = False) -> DataFrame:
    """(book_id, blocks, dropped, page_numbers, words): what pruning running heads leaves of each book, by two aggregates and no join."""
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    by_norm = judged(lines, unicode_norm).groupBy("book_id", F.when(F.col("eligible"), F.col("norm")).alias("norm")).agg(F.count(F.lit(1)).alias("n"), count(X.is_page_number("words"), "page_numbers"), F.sum(F.size("words")).alias("words"))
    heads = F.when(F.col("norm").isNotNull() & (F.col("n") >= C.RUNNING_HEAD_MIN_REPEATS), F.col("n")).otherwise(0)
    return by_norm.groupBy("book_id").agg(F.sum("n").alias("blocks"), F.sum(heads).alias("dropped"), F.sum("page_numbers").alias("page_numbers"), F.sum("words").alias("words"))


def folios(lines: DataFrame) -> DataFrame:
    """(book_id, folio): distinct page numbers that stand alone or end a paragraph of eight words or more."""
    last = F.element_at("words", -1)
    first = F.get("words", 0)
    folio = F.when(X.is_page_number("words"), X.leading_digits(first)).when((F.size("words") >= C.FOLIO_MIN_PARAGRAPH_WORDS) & X.is_digits(last), X.leading_digits(last))
    return lines.select("book_id", folio.alias("folio")).where(F.col("folio") != "").distinct()


def strips_folios(lines: DataFrame) -> DataFrame:
    """(book_id, evidence, strip): strip where at least four distinct page numbers are seen."""
    return folios(lines).groupBy("book_id").agg(F.count(F.lit(1)).alias("evidence")).withColumn("strip", F.col("evidence") >= C.FOLIO_MIN_EVIDENCE)


def prune(blocks: DataFrame, options: Options = Options()) -> DataFrame:
    """Blocks without folios and running heads, judged over the whole book; trimmed_word has a folio taken from a paragraph's end."""
    plain = (F.col("type") == "PARAGRAPH") & F.col("anchor_id").isNull() & (F.size("words") > 0)
    lines = blocks.where(plain).select("book_id", "spine_index", "block_index", texts().alias("words"))
    marked = counted(lines, options.unicode_norm).join(strips_folios(lines).select("book_id", "strip"), "book_id", "left")
    strip = F.coalesce("strip", F.lit(False))
    last = F.element_at("words", -1)
    gone = (X.is_page_number("words") & strip) | (F.coalesce("repeats", F.lit(0)) >= C.RUNNING_HEAD_MIN_REPEATS)
    trim = strip & (F.size("words") >= C.FOLIO_MIN_PARAGRAPH_WORDS) & X.is_digits(last) & (X.leading_digits(last) != "")
    verdict = marked.select("book_id", "spine_index", "block_index", gone.alias("_gone"), F.when(trim, last).alias("trimmed_word"))
    out = blocks.join(verdict, ["book_id", "spine_index", "block_index"], "left").where(~F.coalesce("_gone", F.lit(False)))
    shorter = F.when(F.col("trimmed_word").isNotNull(), F.slice("words", 1, F.size("words") - 1)).otherwise(F.col("words"))
    order = W.partitionBy("book_id", "spine_index").orderBy("block_index")
    return out.withColumn("words", shorter).drop("_gone").withColumn("block_index", F.row_number().over(order) - 1)


def is_heading(kind: Column, words: Column, bold: Column, ratio: Column, centered: Column) -> Column:
    styled = bold | ((ratio >= F.lit(C.HEADING_MIN_RATIO).cast("float")) & centered)
    return (kind == "PARAGRAPH") & F.size(words).between(1, C.HEADING_MAX_WORDS) & ~X.is_page_number(words) & styled


def heading_level(page_break: Column, ratio: Column) -> Column:
    return F.when(page_break | (ratio >= F.lit(C.TITLE_RATIO).cast("float")), 1).otherwise(2)


def promote(blocks: DataFrame) -> DataFrame:
    """Paragraphs that their typography makes headings become such, with title, level, style and an anchor."""
    bold = (F.size("words") > 0) & F.forall("words", lambda w: w["style"].bitwiseAND(C.BOLD) != 0)
    found = is_heading(F.col("type"), texts(), bold, F.col("css_font_ratio"), F.col("css_centered")) & ~F.col("css_heading")
    restyled = F.transform("words", lambda w: w.withField("style", w["style"].bitwiseOR(C.BOLD | C.HEADING)))
    out = blocks.withColumn("_h", found)
    return out.withColumns(
        {
            "heading_level": F.when(F.col("_h"), heading_level(F.col("css_page_break"), F.col("css_font_ratio"))).otherwise(F.col("heading_level")),
            "section_title": F.when(F.col("_h"), plain_text()).otherwise(F.col("section_title")),
            "anchor_id": F.when(F.col("_h"), F.coalesce("anchor_id", X.synthetic_anchor(F.col("spine_index"), F.col("block_index")))).otherwise(F.col("anchor_id")),
            "css_heading": F.col("css_heading") | F.col("_h"),
            "type": F.when(F.col("_h"), "HEADING").otherwise(F.col("type")),
            "words": F.when(F.col("_h"), restyled).otherwise(F.col("words")),
        }
    ).drop("_h")


def chapter_titles(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """chapters(book_id, spine_index, title, ...) with the title of their first titled heading, where there is one."""
    first = blocks.where((F.col("type") == "HEADING") & F.col("section_title").isNotNull()).groupBy("book_id", "spine_index").agg(F.min_by("section_title", "block_index").alias("_t"))
    return chapters.join(first, ["book_id", "spine_index"], "left").withColumn("title", F.coalesce("_t", "title")).drop("_t")
